"""Looking things up in a graph, and answers to questions that its facts decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import answers, text
from tessera.operators import graph as G


def nodes_by_id(graph: G.PropertyGraph, ids: list[str]) -> DataFrame:
    return graph.nodes.where(F.col("id").isin(ids))


def nodes_by_name(graph: G.PropertyGraph, names: list[str]) -> DataFrame:
    return graph.nodes.where(text.name_key_loose(F.col("name")).isin([x.strip().lower() for x in names]))


def nodes_by_type(graph: G.PropertyGraph, types: list[str]) -> DataFrame:
    return graph.nodes.where(F.col("type").isin(types))


def edges_between(graph: G.PropertyGraph, pairs: DataFrame) -> DataFrame:
    """All edges of pairs (src, dst), in their direction."""
    return graph.edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"])


def outgoing(graph: G.PropertyGraph, starts: DataFrame, types: list[str] | None = None) -> DataFrame:
    """The edges that leave starts (id)."""
    e = graph.edges.where(F.col("type").isin(types)) if types else graph.edges
    return e.join(starts.select(F.col("id").alias("src")).distinct(), "src")


def neighbours(graph: G.PropertyGraph, starts: DataFrame, types: list[str] | None = None, node_types: list[str] | None = None) -> DataFrame:
    """start, type, id: what edges that leave starts (id) lead to, each once, of some types. One shuffle by start serves the join and the distinct rows."""
    e = graph.edges.select("src", "type", "dst")
    e = e.where(F.col("type").isin(types)) if types else e
    rows = e.count()
    if node_types:
        e = e.join(nodes_by_type(graph, node_types).select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "type", "dst")
    own = G.spread(starts.select(F.col("id").alias("src")), rows, "src").distinct()  # in the parts of the edges
    return G.spread(e, rows, "src").join(own, "src").select(F.col("src").alias("start"), "type", F.col("dst").alias("id")).distinct()


def _facts(graph: G.PropertyGraph) -> DataFrame:
    key = lambda c: text.name_key_loose(F.col(c))
    return G.named(graph).select(key("src_name").alias("s"), "type", key("dst_name").alias("o")).distinct()


def truth_answers(claims: DataFrame, graph: G.PropertyGraph) -> DataFrame:
    """id, answer of claims (id, subject, type, object; names): true or false where both names are known, else too little is known."""
    key = lambda c: text.name_key_loose(F.col(c))
    names = graph.nodes.select(text.name_key_loose(F.col("name")).alias("k")).distinct()
    c = claims.select("id", key("subject").alias("s"), "type", key("object").alias("o"))
    holds = c.join(_facts(graph).withColumn("holds", F.lit(True)), ["s", "type", "o"], "left")
    known = holds.join(names.select(F.col("k").alias("s"), F.lit(True).alias("has_s")), "s", "left").join(names.select(F.col("k").alias("o"), F.lit(True).alias("has_o")), "o", "left")
    too_little = "Không đủ thông tin"
    return known.select("id", F.when(F.col("holds"), C.TRUE_LABEL).when(F.col("has_s") & F.col("has_o"), C.FALSE_LABEL).otherwise(too_little).alias("answer"))


def choice_answers(questions: DataFrame, graph: G.PropertyGraph) -> DataFrame:
    """id, answer: the first letter whose option makes a fact; null if none does.

    questions: id, question (with options A to D), type, name, and forward: whether name is the subject and the options objects.
    """
    each = questions.select("id", "type", text.name_key_loose(F.col("name")).alias("name"), "forward", F.explode(answers.options(F.col("question"))).alias("option"))
    each = each.select("id", "type", F.substring("option", 1, 1).alias("letter"), "name", text.name_key_loose(F.expr("substring(option, 4)")).alias("other"), "forward")
    asked = each.select("id", "letter", "type", F.when(F.col("forward"), F.col("name")).otherwise(F.col("other")).alias("s"), F.when(F.col("forward"), F.col("other")).otherwise(F.col("name")).alias("o"))
    found = asked.join(_facts(graph), ["s", "type", "o"], "left_semi").groupBy("id").agg(F.min("letter").alias("answer"))
    return questions.select("id").join(found, "id", "left")


def answered(questions: DataFrame, graph: G.PropertyGraph) -> DataFrame:
    """id, answer of a whole table: q_type TRUE_FALSE (subject, type, object) and MCQ (question, type, name, forward)."""
    tf, mcq = questions.where("q_type = 'TRUE_FALSE'"), questions.where("q_type = 'MCQ'")
    return truth_answers(tf, graph).unionByName(choice_answers(mcq, graph))


def pattern_counts(rows: DataFrame, k: int = 10) -> DataFrame:
    """hop_count, pattern, n, rank: the k most common sequences of edge types of each hop count. rows: reasoning_path (text)."""
    from tessera.operators.profiles import top

    path = text.path_array(F.col("reasoning_path"))
    p = rows.select((F.floor((F.size(path) - 1) / 2)).cast("int").alias("hop_count"), F.array_join(text.path_relations(path), "|").alias("pattern"))
    counts = p.groupBy("hop_count", "pattern").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, ["hop_count"], [F.desc("n"), F.col("pattern")], k)


def context(rows: DataFrame, id_column: str, text_column: str, most: int = 5, characters: int = 1000) -> DataFrame:
    """One text for each id of its first `most` lines (by rank), cut to so many characters. rows: id, rank, text."""
    parts = rows.groupBy(id_column).agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", text_column)))).alias("x"))
    return parts.select(id_column, F.substring(F.array_join(F.transform("x", lambda r: r[text_column]), "\n"), 1, characters).alias("context"))


def transform_counts(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """One row: processed, changed, removed (null or empty after), kept: what a transform did to a column."""
    both = before.select(key, F.col(column).alias("a")).join(after.select(key, F.col(column).alias("b")), key, "left")
    there = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return both.agg(F.count_if(there("a")).alias("processed"), F.count_if(there("a") & there("b") & (F.col("a") != F.col("b"))).alias("changed"), F.count_if(there("a") & ~there("b")).alias("removed"), F.count_if(there("a") & F.col("a").eqNullSafe(F.col("b"))).alias("kept"))


def virtual_counts(virtual: DataFrame, edges: DataFrame) -> DataFrame:
    """type, n: virtual edges by type, and as TERMS the edges that carry a term."""
    terms = edges.agg(F.count_if(F.try_element_at("properties", F.lit("term_start")).isNotNull() | F.try_element_at("properties", F.lit("term_end")).isNotNull()).alias("n")).select(F.lit("TERMS").alias("type"), "n")
    return virtual.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(terms)


def born_since(nodes: DataFrame, year: int = 1900) -> DataFrame:
    """Nodes born in that year or later, or at no known time."""
    from tessera.functions.dates import first_year

    y = first_year(F.try_element_at("properties", F.lit("birth_date")))
    return nodes.where(y.isNull() | (y >= year))
