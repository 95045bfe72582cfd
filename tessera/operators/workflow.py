"""Question answering over a graph as an iteration of pattern queries. Models are interfaces: extraction, stopping and answering have offline forms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import names, patterns
from tessera.operators.graph import PropertyGraph


def pattern_scores(question: Column, n_entities: Column, intent: Column) -> dict[str, Column]:
    """The score of each multi-hop pattern of a question, before best_pattern() settles what none of them explains."""
    q, w = F.lower(question), C.PATTERN_WEIGHTS
    has = lambda *words: F.coalesce(_any(q, words), F.lit(False))
    when = lambda cond, value: F.when(cond, value).otherwise(0.0)
    s = {p: F.lit(0.0) for p in C.PATTERN_ORDER}
    for p, words in C.PATTERN_KEYWORDS.items():
        hit = F.lit(False)
        for k in words:
            hit = hit | q.rlike(k)
        s[p] = s[p] + when(hit, w["keyword_match"])
    n = w["entity_count"]
    s["simple"] += when(n_entities == 1, n)
    s["path"] += when(n_entities == 2, n * 0.5)
    s["comparison"] += when(n_entities == 2, n * 0.5)
    s["explore"] += when(n_entities >= 3, n)
    for p in ("chain", "simple"):
        s[p] += when(F.coalesce(intent.isin([k for k, v in C.INTENT_PATTERN.items() if v == p]), F.lit(False)), w["intent_relation"])
    t = w["question_structure"]
    s["explore"] += when(has(" và ", ", "), t * 0.6)
    s["comparison"] += when(has(" hay ", " hoặc "), t * 0.6)
    s["explore"] += when(has("đúng hay sai", "đúng không", "có phải", "có đúng"), t * 0.8)
    s["explore"] += when(question.rlike(r"[A-D][.)]\s+"), t * 0.8)
    s["path"] += when(has("giữa", "mối quan hệ", "liên kết"), t * 0.7)
    return {p: F.round(x, 6) for p, x in s.items()}


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def best_pattern(scores: dict[str, Column]) -> Column:
    """struct(score, pattern): the highest, the first of equals; below 0.3 it is explore, with 0.5 more."""
    each = F.array(*[F.struct(x.alias("score"), F.lit(-i).alias("first"), F.lit(p).alias("pattern")) for i, (p, x) in enumerate(scores.items())])
    top = F.array_max(each)
    settled = F.struct((scores["explore"] + 0.5).alias("score"), F.lit("explore").alias("pattern"))
    return F.when(top["score"] < 0.3, settled).otherwise(F.struct(top["score"].alias("score"), top["pattern"].alias("pattern")))


def plan(pattern: Column) -> Column:
    """The steps of a pattern's plan."""
    out = F.when(F.lit(False), F.array(F.lit("")))
    for p, steps in C.PLANS.items():
        out = out.when(pattern == p, F.array(*[F.lit(x) for x in steps]))
    return out


#: The route of what isn't answered, and what is said then.
OUT_OF_SCOPE = "out_of_scope"
REFUSAL = "Xin lỗi, tôi chỉ có thể trả lời các câu hỏi liên quan đến chính trị gia Việt Nam. Vui lòng hỏi về chủ đề này."


def intents(routed: DataFrame, gated: DataFrame) -> DataFrame:
    """id, intent, confirmed, score, reply of questions: the router decides, and what it sends out of scope is answered at once.

    routed: id, label (null: out of scope); gated: query_id, best, passes, the graph's own say, which is kept beside the intent and
    is null for questions out of scope, as nothing asks it there. A question without a gate's row isn't confirmed, at a score of 1.
    """
    intent = F.coalesce("label", F.lit(OUT_OF_SCOPE))
    inside = F.col("intent") != OUT_OF_SCOPE
    rows = routed.select("id", intent.alias("intent")).join(gated.select(F.col("query_id").alias("id"), "best", "passes"), "id", "left")
    return rows.select("id", "intent", F.when(inside, F.coalesce("passes", F.lit(False))).alias("confirmed"), F.when(inside, F.coalesce("best", F.lit(1.0))).alias("score"), F.when(~inside, REFUSAL).alias("reply"))


def dictionary_entities(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text, type: the nodes whose whole name stands in a question, in whole words."""
    return names.standing(questions, nodes).select("id", F.col("name").alias("text"), "type")


@dataclass
class Answering:
    """What a run over one question has found. enough(question, rows) is the model's say on stopping."""

    graph: PropertyGraph
    source: str = "Politician"
    labels: tuple[str, ...] = patterns.EXPLORED
    relations: dict[str, patterns.Pattern] = field(default_factory=lambda: patterns.PATTERNS)
    most_entities: int = 10
    enough: Callable[[str, list], bool] | None = None

    def step(self, kind: str, question: str, entities: list[dict[str, str]], intent: str | None, previous: DataFrame | None) -> DataFrame | None:
        """A step's query, with the next weaker one where it has nothing to go by."""
        names = [e["text"] for e in entities if e["type"] == self.source]
        if kind == "intent" and intent is not None:
            q = patterns.from_intent(self.graph, intent, entities, self.relations)
            if q is not None:
                return q
        if kind == "path" and len(names) > 1:
            return patterns.path_query(self.graph, names[0], names[1], source=self.source, labels=(self.source, *self.labels))
        if kind == "comparison" and len(names) > 1 and intent is not None:
            return patterns.comparison(self.graph, intent, names)
        if previous is not None:
            more = patterns.harvested(previous, names)
            if more:
                return patterns.exploration(self.graph, more, 15, names, self.labels, self.source)
        if names:
            return patterns.exploration(self.graph, names, labels=self.labels, source=self.source)
        return patterns.any_persons(self.graph, self.source)

    def run(self, question: str, entities: list[dict[str, str]], intent: str | None, pattern: str) -> list[tuple[int, str, list]]:
        """(hop, step, rows) until the plan ends, a step is empty or brings nothing new, or the model has enough. Steps return at most a few dozen rows."""
        out, known, previous = [], {e["text"] for e in entities}, None
        for hop, kind in enumerate(C.PLANS[pattern], 1):
            frame = self.step(kind, question, entities, intent, previous)
            rows = frame.collect() if frame is not None else []
            out.append((hop, kind, rows))
            new = [v for r in rows for k in patterns.ENTITY_KEYS if k in r and (v := r[k]) and len(v) > 2 and v not in known]
            if not rows or kind in ("path", "comparison") or not new or (self.enough and self.enough(question, rows)):
                break
            for v in dict.fromkeys(new):
                if len(entities) < self.most_entities:
                    entities = [*entities, {"text": v, "type": self.source}]
                known.add(v)
            previous = frame
        return out


def recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("_n", at).where(F.col("_n") <= n).drop("_n")
