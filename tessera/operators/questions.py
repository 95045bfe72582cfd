"""Questions from graph paths: candidates, false ones, choices, balance and samples. Chance is the order of a seeded hash, so that runs agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import dates, text
from tessera.operators.graph import cut


def draw(seed: int, *keys: Column | str) -> Column:
    """A number for each key, in an order that no one would guess: Knuth's multiplicative hash of whole numbers, xxhash64 of all else."""
    return F.xxhash64(F.lit(seed), *keys)


def virtual_edges(persons: DataFrame, served: DataFrame, both: bool = True) -> DataFrame:
    """BORN_YEAR, DIED_YEAR and TERM_DURATION edges to nodes YEAR_yyyy and DURATION_…. persons: id, birth_date, death_date; served: src, term_start, term_end."""
    out = None
    for kind, column in (("BORN_YEAR", "birth_date"), ("DIED_YEAR", "death_date")):
        y = dates.first_year(F.col(column))
        e = persons.where(y.isNotNull()).select(F.col("id").alias("src"), F.concat(F.lit("YEAR_"), y.cast("string")).alias("dst"), F.lit(kind).alias("type"), y.cast("string").alias("name"))
        out = e if out is None else out.unionByName(e)
    label = dates.duration_label(F.col("term_start"), F.col("term_end"), both)
    terms = served.withColumn("name", label).where("name is not null").select("src", F.concat(F.lit("DURATION_"), F.col("name")).alias("dst"), F.lit("TERM_DURATION").alias("type"), "name")
    return out.unionByName(terms)


def reuse_cap(candidates: DataFrame, signature: list[str], most: int, order: list[Column]) -> DataFrame:
    """At most so many candidates of one signature: a feature of the question sets."""
    n = F.row_number().over(Window.partitionBy(*signature).orderBy(*order))
    return candidates.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def pools(nodes: DataFrame) -> DataFrame:
    """type, place (from 0), size, id, name: the nodes of each type in order. Numbered by partial counts over ranges of ids, not in one task per type."""
    # cut, as the range partitioner may draw other bounds when it runs again
    parts = cut(nodes.select("id", "type", "name").repartitionByRange("type", "id").sortWithinPartitions("type", "id").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("type", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.groupBy("type").agg(F.sum("n").alias("size"))
    return parts.join(before.select("type", "_part", "_first", "before"), ["type", "_part"]).join(total, "type").select("type", (F.col("_at") - F.col("_first") + F.col("before")).alias("place"), "size", "id", "name")


def false_candidates(candidates: DataFrame, pool: DataFrame, facts: DataFrame, pick: Column) -> DataFrame:
    """Candidates (id, src, type, dst, dst_type) with another node of the target's type in its place; those that are true after all go.

    pick: a number of 0 or more for each candidate, whose remainder by the pool's size is the place taken.
    """
    sizes = pool.groupBy(F.col("type").alias("dst_type")).agg(F.max("size").alias("size"))
    c = candidates.join(F.broadcast(sizes), "dst_type").withColumn("place", F.pmod(pick, F.col("size")))  # a row per type
    new = c.join(pool.select(F.col("type").alias("dst_type"), "place", F.col("id").alias("false_dst")), ["dst_type", "place"]).where("false_dst <> dst")
    known = facts.select("src", "type", F.col("dst").alias("false_dst")).distinct()
    return new.join(known, ["src", "type", "false_dst"], "left_anti").select("id", "src", "type", "dst", "false_dst")


def choices(questions: DataFrame, pool: DataFrame, pick: Column, wrong: int = 3) -> DataFrame:
    """id, choices (A. to D.), letter: the answer among `wrong` others of its type, at a place that goes round by question number.

    questions: id, number, answer_type, answer (name). The others stand at the places after pick in the pool.
    """
    names = pool.groupBy("type", "name").agg(F.min("id").alias("id"))
    numbered = pools(names.select("id", "type", "name"))
    sizes = numbered.groupBy(F.col("type").alias("answer_type")).agg(F.max("size").alias("size"))
    q = questions.join(F.broadcast(sizes), "answer_type").where(F.col("size") > wrong)
    each = q.select("id", "number", "answer_type", "answer", F.explode(F.transform(F.sequence(F.lit(0), F.lit(wrong)), lambda i: F.pmod(pick + i, F.col("size")))).alias("place"))
    drawn = each.join(numbered.select(F.col("type").alias("answer_type"), "place", "name"), ["answer_type", "place"]).where("name <> answer")
    others = drawn.groupBy("id", "number", "answer").agg(F.slice(F.array_sort(F.collect_set("name")), 1, wrong).alias("others"))
    return lettered(others, wrong)


def lettered(rows: DataFrame, wrong: int) -> DataFrame:
    """id, choices (A. to D.), letter of rows (id, number, answer, others): the answer stands at a place that goes round by number."""
    at = F.pmod("number", F.lit(wrong + 1))
    ordered = F.concat(F.slice("others", F.lit(1), at), F.array("answer"), F.slice("others", at + 1, F.lit(wrong)))
    letters = F.array(*[F.lit(c) for c in "ABCDEFGH"[: wrong + 1]])
    return rows.select("id", F.zip_with(F.slice(letters, F.lit(1), F.size(ordered)), ordered, lambda a, b: F.concat(a, F.lit(". "), b)).alias("choices"), F.element_at(letters, (at + 1).cast("int")).alias("letter"))


#: How far wrong years and wrong durations are from the answer, at most.
YEAR_SPREAD, DURATION_SPREAD = 20, 10


def time_choices(questions: DataFrame, pick: Callable[[Column], Column], wrong: int = 3) -> DataFrame:
    """id, choices, letter of questions for a year or a duration, among others near it. questions: id, number, answer_type (Year, Duration), answer.

    pick(offset): the order of a question's offsets, of which the first `wrong` are taken; a duration's years move together, its
    length stays. Cases: a Year that isn't a whole number and a Duration without four digits have no row; a Duration with one
    year is answered among such with one year, whatever its end says.
    """
    year = F.col("answer_type") == "Year"
    years = F.when(year, F.array(F.col("answer").try_cast("int"))).when(F.col("answer_type") == "Duration", F.transform(F.regexp_extract_all("answer", F.lit(r"(\d{4})"), 1), lambda y: y.cast("int")))
    q = questions.withColumn("_years", years).where(F.get("_years", F.lit(0)).isNotNull())
    spread = F.when(year, YEAR_SPREAD).otherwise(DURATION_SPREAD)
    offsets = F.filter(F.sequence(-spread, spread), lambda o: o != 0)
    taken = F.slice(F.array_sort(F.transform(offsets, lambda o: F.struct(pick(o).alias("by"), o.alias("o")))), 1, wrong)
    first, last = F.get("_years", F.lit(0)), F.get("_years", F.lit(1))
    said = lambda o: F.when(year, (first + o).cast("string")).otherwise(F.concat(F.lit("từ "), (first + o).cast("string"), F.coalesce(F.concat(F.lit(" đến "), (last + o).cast("string")), F.lit(""))))
    return lettered(q.withColumn("others", F.transform(taken, lambda x: said(x["o"]))), wrong)


def with_office(question: Column, offices: Column) -> Column:
    """A question about who followed whom, with the office in brackets where the path has one. offices: the names along the path.

    Cases: a question that asks for no succession or a path without offices stays as it is; with several offices, or one that
    the question names, only the end is made a question mark.
    """
    asks = F.contains(question, F.lit("kế nhiệm")) | F.contains(question, F.lit("tiền nhiệm"))
    one = (F.size(offices) == 1) & ~F.exists(offices, lambda o: F.contains(question, o))
    said = F.concat(F.regexp_replace(question, r"[?.]+$", ""), F.when(one, F.concat(F.lit(" (trong chức vụ "), F.get(offices, F.lit(0)), F.lit(")"))).otherwise(""), F.lit("?"))
    return F.when(asks & (F.size(offices) > 0), said).otherwise(question)


def in_context(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (id, question, types, offices: each edge's position_id or null, and more) with the question made specific by its offices' names."""
    each = rows.select("id", F.posexplode(F.zip_with("types", "offices", lambda t, o: F.when(t.isin("PRECEDED", "SUCCEEDED"), o))).alias("at", "office")).where("office is not null")
    named = each.join(nodes.select(F.col("id").alias("office"), "name").where("name <> ''"), "office").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("_offices"))
    known = F.coalesce("_offices", F.expr("cast(array() as array<string>)"))
    return rows.join(named, "id", "left").withColumn("question", with_office(F.col("question"), known)).drop("_offices")


def statistics(questions: DataFrame, by: tuple[str, ...] = ("q_type", "hop_count")) -> DataFrame:
    """section, label, n, percent of the section: questions by each column of `by`, true-false ones by answer, the others by letter. One aggregation of small counts."""
    kinds = [F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("label")) for c in by]
    answer = F.struct(F.when(F.col("q_type") == "TRUE_FALSE", "truth").otherwise("letter").alias("section"), F.col("answer").alias("label"))
    n = questions.select(F.inline(F.array(*kinds, answer))).where("label is not null").groupBy("section", "label").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("section").agg(F.sum("n").alias("_total"))
    return n.join(total, "section").select("section", "label", "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"))


def with_fallbacks(pool: DataFrame, wrong: int = 3) -> DataFrame:
    """nodes (id, type, name) for choices(): a type with too few names gets those of its fallback types too, after its own."""
    named = pool.where(F.length("name") > 2).groupBy("type", "name").agg(F.min("id").alias("id"))
    have = {r.type: r.n for r in named.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per type
    out = named.select("id", "type", "name")
    for kind, others in C.FALLBACK_TYPES.items():
        if have.get(kind, 0) <= wrong:
            out = out.unionByName(named.where(F.col("type").isin(*others)).select("id", F.lit(kind).alias("type"), "name"))
    return out


#: What a question without an answer in the data is answered by.
NOT_GIVEN, LETTERS = "Not Given", "ABCD"


def unanswerable(rows: DataFrame, pick: Column) -> DataFrame:
    """Questions (q_type, choices, answer, and more) that the data doesn't answer: true-false ones are not given, of four choices the one at
    pick modulo 4 becomes that there are no data and the answer. Without four choices the answer is D, and choices stay as they are."""
    full, at = F.coalesce(F.size("choices") == len(LETTERS), F.lit(False)), F.pmod(pick, F.lit(len(LETTERS))).cast("int")
    letter = F.array(*[F.lit(c) for c in LETTERS])
    truth = F.col("q_type") == "TRUE_FALSE"
    placed = F.transform("choices", lambda c, i: F.when(i == at, F.concat(F.get(letter, at), F.lit(f") {C.NO_DATA_LABEL}"))).otherwise(c))
    return rows.withColumns({"choices": F.when(~truth & full, placed).otherwise(F.col("choices")), "answer": F.when(truth, NOT_GIVEN).when(full, F.get(letter, at)).otherwise("D")})


def distinct_questions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of questions with one text the first by the order."""
    first = rows.groupBy("question").agg(F.min(F.struct(*order)).alias("_first")).select(F.col("question").alias("_q"), "_first")
    return rows.join(first, (F.col("question") == F.col("_q")) & (F.struct(*order) == F.col("_first")), "left_semi").dropDuplicates(["question"])


def six_questions(edges: DataFrame) -> DataFrame:
    """Each edge (edge_id, src_name, type, dst_name) as true, false and choice questions, forwards and backwards."""
    kinds = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(k).alias("kind")) for d in ("forward", "backward") for k in ("TF_TRUE", "TF_FALSE", "MCQ")])
    e = edges.select("*", F.inline(kinds))
    phrase = F.when(F.col("direction") == "forward", text.relation_phrase(F.col("type"))).otherwise(text.relation_phrase(F.col("type"), "backward"))
    a, b = (F.when(F.col("direction") == "forward", F.col(x)).otherwise(F.col(y)) for x, y in (("src_name", "dst_name"), ("dst_name", "src_name")))
    said = F.when(F.col("kind") == "MCQ", text.render("{a} {p}?", a=a, p=phrase)).otherwise(text.render("{a} {p} {b}. Đúng hay sai?", a=a, p=phrase, b=b))
    answer = F.when(F.col("kind") == "TF_TRUE", C.TRUE_LABEL).when(F.col("kind") == "TF_FALSE", C.FALSE_LABEL).otherwise(b)
    return e.select("edge_id", "direction", "kind", said.alias("question"), answer.alias("answer"))


def multi_hop_text(names: Column, types: Column, choice: bool) -> Column:
    """A question along a path of 1 to 4 edges, given node names and edge types."""
    n = F.size(types)
    if choice:
        joints = F.array(F.lit(""), F.lit(", người/thực thể đó "), F.lit(", tiếp theo "), F.lit(", và cuối cùng "))
        joint = lambda i: F.when(i == 0, F.concat(F.get(names, F.lit(0)), F.lit(" "))).when((n == 2), ", và người/thực thể đó ").when(i == n - 1, ", và cuối cùng ").otherwise(F.get(joints, i))
        return F.concat(F.array_join(F.transform(types, lambda t, i: F.concat(joint(i), text.relation_phrase(t, "question"))), ""), F.lit("?"))
    part = lambda t, i: F.concat(F.when((i == n - 1) & (n > 1), "và ").otherwise(""), F.get(names, i), F.lit(" "), text.relation_phrase(t), F.lit(" "), F.get(names, i + 1))
    return F.concat(F.array_join(F.transform(types, part), ", "), F.lit(". Đúng hay sai?"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], column: str) -> DataFrame:
    """rows with their place (from 0) in their group, by counts over ranges: no task sorts a whole group."""
    by = [f"_by{i}" for i in range(len(order))]
    numbered = renumbered(rows.select("*", *[c.alias(b) for c, b in zip(_plain(order), by, strict=True)]), [*keys, *by], column="_rank")
    first = numbered.groupBy(*keys).agg(F.min("_rank").alias("_first")).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_first")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    return numbered.join(cut(first), same).withColumn(column, F.col("_rank") - F.col("_first")).drop("_rank", "_first", *by, *[f"_{i}" for i in range(len(keys))])


def _plain(order: list[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in order]


def balanced(questions: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """slot 0 to n - 1 for each question, in turn within its group: true and false, or the place of the answer, come out even."""
    return ranked(questions, keys, order, "_at").withColumn("slot", F.pmod("_at", F.lit(n))).drop("_at")


def stratified(rows: DataFrame, targets: dict[tuple, int], keys: list[str], order: list[Column]) -> DataFrame:
    """As many rows of each stratum as its target says, by the given order; strata without a target go."""
    spark = rows.sparkSession
    t = spark.createDataFrame([(*k, n) for k, n in targets.items()], ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", _target int")
    return ranked(rows.join(F.broadcast(t), keys), keys, order, "_n").where("_n < _target").drop("_n", "_target")


def filled(rows: DataFrame, hop: int, special: dict[str, int], total: int, order: list[Column]) -> DataFrame:
    """The sample of one hop count: special variants up to their counts, then Normal ones up to the total. rows: hop_count, variant_type."""
    numbered = ranked(rows.where(F.col("hop_count") == hop), ["variant_type"], order, "_n")
    limit = F.lit(0)
    for v, k in special.items():
        limit = F.when(F.col("variant_type") == v, k).otherwise(limit)
    chosen = numbered.where(F.col("variant_type").isin(*special) & (F.col("_n") < limit))
    have = chosen.agg(F.count(F.lit(1)).alias("_have"))
    rest = numbered.where("variant_type = 'Normal'").join(F.broadcast(have)).where(F.col("_n") < total - F.col("_have"))  # one row
    return chosen.drop("_n").unionByName(rest.drop("_n", "_have"))


def renumbered(rows: DataFrame, order: list[str], first: int = 1, column: str = "id") -> DataFrame:
    """New numbers from `first` in the given order, by partial counts over ranges."""
    parts = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    out = parts.join(F.broadcast(before.select("_part", "_first", "before")), "_part")
    return out.withColumn(column, F.col("_at") - F.col("_first") + F.col("before") + first).drop("_part", "_at", "_first", "before")


def appended(rows: DataFrame, more: DataFrame, order: list[str]) -> DataFrame:
    """rows, and more with ids that go on from the largest."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(0))).head()[0]
    return rows.unionByName(renumbered(more.drop("id"), order, top + 1).select(*rows.columns))


def quotas(total: int, multi: float = 0.8, split: tuple[float, ...] = (0.5, 0.3, 0.2), available: dict[int, int] | None = None) -> dict[int, int]:
    """Questions of each hop count; what a pool lacks goes to the next longer one."""
    out = {1: total - round(total * multi)}
    for i, s in enumerate(split[:-1]):
        out[i + 2] = int(round(total * multi) * s)
    out[len(split) + 1] = total - sum(out.values())
    if available is not None:
        for h in sorted(out):
            short = max(0, out[h] - available.get(h, 0))
            out[h] -= short
            if h + 1 in out:
                out[h + 1] += short
    return out


def negated(rows: DataFrame, percent: int, key: Column) -> DataFrame:
    """A share of true-false questions, by the key, asks for the opposite: the answer turns."""
    turn = F.pmod(key, F.lit(100)) < percent
    return rows.withColumn("negative", turn).withColumn("answer", F.when(turn & (F.col("answer") == C.TRUE_LABEL), C.FALSE_LABEL).when(turn & (F.col("answer") == C.FALSE_LABEL), C.TRUE_LABEL).otherwise(F.col("answer")))


def variants(seeds: DataFrame, replies: DataFrame) -> DataFrame:
    """Model variants (id, variant_type, question) of seed questions that differ from them and have 10 characters; unanswerable ones have no data as answer."""
    r = replies.select("id", "variant_type", F.col("question").alias("new"))
    ok = seeds.drop("variant_type").join(r, "id").where((F.lower(F.trim("new")) != F.lower(F.trim("question"))) & (F.length(F.trim("new")) >= 10))
    return ok.withColumn("question", F.col("new")).withColumn("answer", F.when(F.col("variant_type") == "UNANSWERABLE", C.NO_DATA_LABEL).otherwise(F.col("answer"))).drop("new")
