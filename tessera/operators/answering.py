"""The answering loop for a table of questions: what `workflow.Answering` does for one, as a few joins a round for all that are still open.

questions: id, question, entities (array of text, type), intent, pattern. The state of a question is a row: what is known, which
names it may look around, whether it is done. A round finds the nodes of all texts that are asked for at once, makes each
question's next step by joins, keeps the first rows of each question in a total order, and settles by columns who goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import paths, patterns
from tessera.operators.graph import PropertyGraph, cut
from tessera.operators.names import contained
from tessera.operators.workflow import plan

ROWS = "id", "place", "relations", "names", "said", "properties"
_NONE = "cast(map() as map<string,string>)"


def first_rows(rows: DataFrame, order: list[Column], limit: Column) -> DataFrame:
    """ROWS of each question up to its limit (a column), in a total order."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit).select(*ROWS)


def nodes_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """text, node, node_type, node_name: the nodes whose name contains a text, in any case."""
    pairs = contained(nodes.select(F.col("name").alias("text")), texts.select(F.col("text").alias("part")))
    return pairs.select(F.col("part").alias("text"), F.col("text").alias("name")).join(nodes, "name").select("text", F.col("id").alias("node"), F.col("type").alias("node_type"), F.col("name").alias("node_name"))


class Answers:
    """The steps over one graph. source: the type of nodes that questions are about; labels: the types that an exploration may end at."""

    def __init__(self, graph: PropertyGraph, source: str = "Politician", labels: tuple[str, ...] = patterns.EXPLORED, relations: dict[str, patterns.Pattern] | None = None, most_entities: int = 10, enough: Callable[[Column, Column], Column] | None = None):
        self.nodes = cut(graph.nodes.select("id", "type", "name").where("name is not null"))
        self.edges = cut(patterns.with_ids(graph).select("edge_id", "src", "dst", "type", "properties"))
        self.source, self.labels, self.relations, self.most_entities, self.enough = source, labels, relations or patterns.PATTERNS, most_entities, enough

    def _first(self, kind: str) -> Column:
        return F.get(F.filter("entities", lambda e: e["type"] == kind), F.lit(0))["text"]

    def answered(self, questions: DataFrame) -> DataFrame:
        """id, hop, kind, place, relations, names, properties: the rows of every step of every question.

        A question ends when its plan does, when a step has no rows or names nothing new, after a path or a comparison, or
        when `enough` (of the question and the array of all rows' names so far) says so. Cases: a question without entities, or of an unknown
        intent, looks around its sources or, having none, at the first sources there are; null entities are none; repeated ids are one question.
        """
        none = F.array().cast("array<string>")
        entities = F.coalesce(F.col("entities"), F.expr("cast(array() as array<struct<text:string,type:string>>)"))
        state = questions.dropDuplicates(["id"]).select("id", "question", entities.alias("entities"), "intent", plan(F.col("pattern")).alias("plan"))
        state = cut(state.select("*", F.transform("entities", lambda e: e["text"]).alias("known"), none.alias("last"), none.alias("seen"), F.lit(False).alias("done")))
        out = []
        for hop in range(1, max(map(len, C.PLANS.values())) + 1):
            live = state.where(~F.col("done") & (F.size("plan") >= hop)).withColumn("kind", F.get("plan", F.lit(hop - 1)))
            live = cut(live.withColumn("sources", F.transform(F.filter("entities", lambda e: e["type"] == self.source), lambda e: e["text"])))
            if live.isEmpty():
                break
            rows = cut(self._step(live).join(live.select("id", "kind"), "id"))
            out.append(rows.select("id", F.lit(hop).alias("hop"), "kind", "place", "relations", "names", "properties"))
            each = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "said", "names"))).alias("r"))  # as many rows as a step's limit
            each = each.select("id", F.array_distinct(F.flatten(F.transform("r", lambda x: x["said"]))).alias("said"), F.flatten(F.transform("r", lambda x: x["names"])).alias("all"))
            after = live.join(each, "id", "left").withColumn("said", F.coalesce("said", none)).withColumn("seen", F.concat("seen", F.coalesce("all", none)))
            fresh = F.filter("said", lambda v: (F.length(v) > 2) & ~F.array_contains("known", v))
            after = after.withColumn("fresh", fresh)
            done = F.col("kind").isin("path", "comparison") | (F.size("fresh") == 0)
            if self.enough is not None:
                done = done | self.enough(F.col("question"), F.col("seen"))
            room = F.greatest(F.lit(self.most_entities) - F.size("entities"), F.lit(0))
            more = F.transform(F.slice("fresh", F.lit(1), room), lambda v: F.struct(v.alias("text"), F.lit(self.source).alias("type")))
            state = cut(after.select("id", "question", F.concat("entities", more).alias("entities"), "intent", "plan", F.concat("known", "fresh").alias("known"), F.col("said").alias("last"), "seen", done.alias("done")))
        schema = "hop int, kind string, place int, relations array<string>, names array<string>, properties map<string,string>"
        return reduce(DataFrame.unionByName, out) if out else questions.select("id", *[F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split()[0]) for x in schema.split(", ")]).limit(0)

    def _step(self, live: DataFrame) -> DataFrame:
        """ROWS of each open question's step, or of the next weaker one where it has nothing to go by."""
        texts = live.select(F.explode(F.array_distinct(F.concat(F.transform("entities", lambda e: e["text"]), "last"))).alias("text"))
        nodes = cut(nodes_of(texts, self.nodes))
        known = F.col("intent").isin(*self.relations)
        asked = F.lit(False)
        for k, p in self.relations.items():
            has = self._first(p.source).isNotNull() | (F.lit(p.source != p.target) & self._first(p.target).isNotNull())
            asked = asked | ((F.col("intent") == k) & has)
        several = F.size("sources") > 1
        way = F.when((F.col("kind") == "intent") & F.coalesce(known & asked, F.lit(False)), "intent").when((F.col("kind") == "path") & several, "path")
        way = way.when((F.col("kind") == "comparison") & several & F.col("intent").isNotNull(), "comparison")
        harvested = F.slice(F.filter("last", lambda v: (F.length(v) > 2) & ~F.array_contains("sources", v)), 1, 5)
        live = live.withColumn("harvest", harvested)
        way = way.when(F.size("harvest") > 0, "harvest").when(F.size("sources") > 0, "around").otherwise("any")
        live = cut(live.withColumn("way", way))
        none = F.array().cast("array<string>")
        around = live.where("way in ('harvest', 'around')").select("id", F.when(F.col("way") == "harvest", F.col("harvest")).otherwise(F.col("sources")).alias("asked"), F.when(F.col("way") == "harvest", 15).otherwise(20).alias("limit"), F.when(F.col("way") == "harvest", F.col("sources")).otherwise(none).alias("explored"))
        intents = [r.intent for r in live.where("way = 'intent'").select("intent").distinct().collect()]  # relations are few
        out = [self._by_intent(live.where((F.col("way") == "intent") & (F.col("intent") == k)), nodes, self.relations[k]) for k in sorted(intents)]
        ways = {r.way for r in live.select("way").distinct().collect()}  # six at most
        if ways & {"harvest", "around"}:
            out.append(self._around(around, nodes))
        if "path" in ways:
            out.append(self._paths(live.where("way = 'path'"), nodes))
        if "comparison" in ways:
            out.append(self._compared(live.where("way = 'comparison'"), nodes))
        if "any" in ways:
            some = self.nodes.where(F.col("type") == self.source).orderBy("id").limit(5).select(F.col("id").alias("node"), "name")
            rows = live.where("way = 'any'").select("id").join(F.broadcast(some)).select("id", "node", none.alias("relations"), F.array("name").alias("names"), F.array("name").alias("said"), F.expr(_NONE).alias("properties"))  # five rows
            out.append(first_rows(rows, [F.col("node")], F.lit(5)))
        return reduce(DataFrame.unionByName, out)

    def _by_intent(self, live: DataFrame, nodes: DataFrame, p: patterns.Pattern) -> DataFrame:
        """The rows of a relation between what the first entities of its two types name; of a succession between sources also its office's."""
        same = p.source == p.target
        asked = live.select("id", self._first(p.source).alias("s"), (F.lit(None).cast("string") if same else self._first(p.target)).alias("t"), (self._first("Position") if same else F.lit(None).cast("string")).alias("office"))
        e = self.edges.where(F.col("type") == p.edge)
        e = e.select(F.col("dst").alias("from"), F.col("src").alias("to"), "properties") if p.inward else e.select(F.col("src").alias("from"), F.col("dst").alias("to"), "properties")
        at = lambda text, kind, end: nodes.where(F.col("node_type") == kind).select(F.col("text").alias(text), F.col("node").alias(end))
        by_source = asked.where("s is not null").join(at("s", p.source, "from"), "s").join(e, "from")
        both = by_source.where("t is not null").join(at("t", p.target, "to"), ["t", "to"])
        columns = ["id", "from", "to", "properties", "s", "t", "office"]
        by_target = asked.where("s is null").join(at("t", p.target, "to"), "t").join(e, "to")
        rows = by_source.where("t is null").select(*columns).unionByName(both.select(*columns)).unionByName(by_target.select(*columns))
        held = nodes.select(F.col("text").alias("office"), F.col("node").alias("held"))
        with_office = rows.where("office is not null").withColumn("held", F.try_element_at("properties", F.lit("position_id"))).join(held, ["office", "held"], "left_semi")
        rows = rows.where("office is null").unionByName(with_office.select(*columns))
        name = lambda kind, end, to: self.nodes.where(F.col("type") == kind).select(F.col("id").alias(end), F.col("name").alias(to))
        rows = rows.join(name(p.source, "from", "a"), "from").join(name(p.target, "to", "b"), "to")
        values = [F.nullif(F.try_element_at("properties", F.lit(k)), F.lit("")).alias(f"p_{k}") for k in p.properties]
        rows = rows.select("id", "a", "b", *values, F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), p.limits[0]).when(F.col("s").isNotNull(), p.limits[1]).otherwise(p.limits[2]).alias("limit"))
        rows = rows.distinct() if p.distinct else rows
        order = [F.col(f"p_{k}").asc_nulls_last() for k in p.order] + [F.col(c).asc_nulls_last() for c in ("a", "b", *[f"p_{k}" for k in p.properties if k not in p.order])]
        said = F.array(*[c for c, k in (("a", p.as_source), ("b", p.as_target)) if k in patterns.ENTITY_KEYS]) if {p.as_source, p.as_target} & {*patterns.ENTITY_KEYS} else F.array().cast("array<string>")
        props = F.map_filter(F.create_map(*[x for k in p.properties for x in (F.lit(k), F.col(f"p_{k}"))]), lambda _, v: v.isNotNull()) if p.properties else F.expr(_NONE)
        return first_rows(rows.withColumns({"relations": F.array(F.lit(p.edge)), "names": F.array("a", "b"), "said": said, "properties": props}), order, F.col("limit"))

    def _around(self, asked: DataFrame, nodes: DataFrame) -> DataFrame:
        """One or two edges around the sources that match the names asked for. Two edges only for questions whose limit one edge doesn't fill, as rows of one edge come first."""
        sources = nodes.where(F.col("node_type") == self.source)
        starts = asked.select("id", "limit", "explored", F.explode("asked").alias("text")).join(sources, "text").select("id", "limit", "explored", F.col("node").alias("start"), F.col("node_name").alias("source_name")).distinct()
        both = paths.both_ways(self.edges).select("edge_id", F.col("src").alias("at"), F.col("dst").alias("to"), F.col("type").alias("relation"))
        end = self.nodes.where(F.col("type").isin(*self.labels) & (F.col("name") != "")).select(F.col("id").alias("to"), F.col("name").alias("to_name"))
        begun = cut(starts.withColumn("at", F.col("start")).join(both, "at").select("id", "limit", "explored", "start", "source_name", "edge_id", "relation", "to"))
        free = ~F.array_contains("explored", F.col("to_name"))
        shape = lambda df, relations, names: df.select("id", "limit", F.array(*relations).alias("relations"), F.array(*names).alias("names"), F.array("source_name").alias("said"), F.expr(_NONE).alias("properties"))
        one = cut(shape(begun.join(end, "to").where(free), ["relation"], ["source_name", "to_name"]))
        enough = one.groupBy("id", "limit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.col("limit")).select("id")
        middle = self.nodes.select(F.col("id").alias("middle"), F.col("name").alias("middle_name"))
        further = begun.join(enough, "id", "left_anti").withColumnsRenamed({"to": "middle", "edge_id": "first", "relation": "first_relation"}).join(middle, "middle")
        two = further.join(both.withColumnRenamed("at", "middle"), "middle").where(F.col("first") != F.col("edge_id")).join(end, "to").where(free)
        rows = one.unionByName(shape(two, ["first_relation", "relation"], ["source_name", "middle_name", "to_name"]))
        return first_rows(rows, [F.size("relations"), F.get("names", F.lit(0)), F.col("relations"), F.col("names")], F.col("limit"))

    def _paths(self, live: DataFrame, nodes: DataFrame) -> DataFrame:
        """The shortest paths between what the first two sources name."""
        asked = live.select("id", F.get("sources", F.lit(0)).alias("s"), F.get("sources", F.lit(1)).alias("t"))
        start = nodes.where(F.col("node_type") == self.source).select(F.col("text").alias("s"), F.col("node").alias("start"))
        end = nodes.where(F.col("node_type").isin(self.source, *self.labels)).select(F.col("text").alias("t"), F.col("node").alias("end"))
        pairs = cut(asked.join(start, "s").join(end, "t").select("id", "start", "end").where("start <> end").distinct())
        found = cut(paths.between(pairs, self.edges, 4, directed=False).join(pairs, ["start", "end"]))
        inside = found.select("id", "start", "end", F.posexplode("path").alias("i", "x")).where("i % 2 = 0").join(self.nodes.select(F.col("id").alias("x"), "name"), "x")
        named = inside.groupBy("id", "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda v: v["name"]).alias("names"))
        rows = found.join(named, ["id", "start", "end"]).select("id", "start", "end", "length", F.filter("path", lambda _, i: i % 2 == 1).alias("relations"), "names", F.array().cast("array<string>").alias("said"), F.expr(_NONE).alias("properties"))
        return first_rows(rows, [F.col("length"), F.col("start"), F.col("end")], F.lit(5))

    def _compared(self, live: DataFrame, nodes: DataFrame) -> DataFrame:
        """How many targets of the relation each of the nodes has that the sources name; the number is the row's property n."""
        asked = live.select("id", "intent", F.explode("sources").alias("text")).join(nodes, "text").select("id", "intent", F.col("node_name").alias("name")).distinct()
        e = self.edges.select("src", F.col("type").alias("intent")).join(self.nodes.select(F.col("id").alias("src"), "name"), "src")
        rows = asked.join(e.groupBy("intent", "name").agg(F.count(F.lit(1)).alias("n")), ["intent", "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        rows = rows.select("id", "n", "name", F.array("intent").alias("relations"), F.array("name").alias("names"), F.array("name").alias("said"), F.create_map(F.lit("n"), F.col("n").cast("string")).alias("properties"))
        return first_rows(rows, [F.desc("n"), F.col("name")], F.lit(1 << 30))
