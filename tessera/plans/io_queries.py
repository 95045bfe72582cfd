"""Queries that write and read back: pages, records, names, graphs, question files, reports; and the relations' pattern queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as G, patterns
from tessera.plans.tables import graph, key, query, read
from tessera.session import shared_dir
from tessera.sources import readers, writers


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/tessera-io-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@query("""
SELECT c_name AS title, CAST(c_custkey AS VARCHAR) AS id, 'infobox officeholder' AS template, n_name AS birth_place, c_mktsegment AS party FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 > 0
""")
def src_infobox_pages(spark: SparkSession, d: str) -> DataFrame:
    """A dump with a page for each customer; every third has no infobox."""
    at = scratch(spark)
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    box = F.concat(F.lit("{{infobox officeholder\n| birth_place = "), "n_name", F.lit("\n| party = {{nowrap|"), "c_mktsegment", F.lit("}}\n| empty = \n}}"))
    text = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("''lead'' {{other|x}} "), box)).otherwise("no box")
    c.select(F.concat(F.lit("<page><title>"), "c_name", F.lit("</title><id>"), F.col("c_custkey").cast("string"), F.lit("</id><revision><text>"), text, F.lit("</text></revision></page>")).alias("value")).write.text(at)
    r = readers.infobox_records(spark, at)
    return r.select("title", "id", "template", F.col("infobox")["birth_place"].alias("birth_place"), F.regexp_extract(F.col("infobox")["party"], r"\|(.*)\}\}", 1).alias("party"))


@query("""
SELECT c_name AS title, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS party FROM customer
""")
def snk_records(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    c = read(spark, d, "customer")
    writers.records(c.select(F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("id"), F.lit("t").alias("template"), F.create_map(F.lit("party"), "c_mktsegment").alias("infobox")), at)
    return readers.records(spark, at).select("title", "id", F.col("infobox")["party"].alias("party"))


@query("""
SELECT DISTINCT trim(p_name) AS value FROM part WHERE trim(p_name) <> ''
""")
def snk_names(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    writers.names(read(spark, d, "part").select(F.concat(F.lit(" "), "p_name").alias("value")), at)
    return readers.names(spark, at)


@query("""
SELECT 'nodes' AS part, 'Nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'nodes', 'Region', count(*) FROM region UNION ALL SELECT 'nodes', 'Customer', count(*) FROM customer
UNION ALL SELECT 'edges', 'IN_REGION', count(*) FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'edges', 'LOCATED_IN', count(*) FROM customer
""")
def snk_graph_tables(spark: SparkSession, d: str) -> DataFrame:
    """A graph as tables, one of whose edge types is replaced."""
    at = scratch(spark)
    g = graph(spark, d, ("LOCATED_IN", "IN_REGION"))
    kept = g.nodes.where("type in ('Nation', 'Region', 'Customer')")
    e = g.edges.where("src not like 'sup%'").drop("edge_id")
    writers.graph_tables(G.PropertyGraph(kept, e), at)
    writers.replace_edges(e.where("type = 'IN_REGION' and cast(substring(src, 4) as int) % 2 = 0"), at)
    back = readers.graph_tables(spark, at)
    count = lambda part, x: x.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "type", "n")
    return count("nodes", back.nodes).unionByName(count("edges", back.edges))


@query("""
SELECT 'cus' || c_custkey AS src, 'nat' || c_nationkey AS dst, c_name AS src_name, 'nation ' || c_nationkey AS dst_name FROM customer
""")
def snk_graph_document(spark: SparkSession, d: str) -> DataFrame:
    """A graph as one document, names with quotes and line breaks among them."""
    at = scratch(spark)
    g = graph(spark, d, ("LOCATED_IN",))
    n = g.nodes.where("type in ('Customer', 'Nation')").withColumns({"name": F.when(F.col("type") == "Nation", F.concat(F.lit('"nation"\n'), F.substring("id", 4, 9))).otherwise(F.col("name")), "properties": F.create_map(F.lit("k"), F.col("id"))})
    writers.graph_document(G.PropertyGraph(n, g.edges.where("src like 'cus%'").drop("edge_id")), at)
    back = readers.graph_document(spark, at)
    return G.named(back).select("src", "dst", "src_name", F.regexp_replace("dst_name", '"nation"\n', "nation ").alias("dst_name"))


@query("""
WITH q AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'MCQ' ELSE 'TF' END AS q_type, 'Where is ' || c_name || '?' AS question, c_custkey FROM customer)
SELECT q_type, row_number() OVER (PARTITION BY q_type ORDER BY question) AS id, question, CASE WHEN q_type = 'MCQ' THEN 'A' WHEN c_custkey % 3 = 0 THEN 'Đúng' ELSE 'Sai' END AS answer FROM q
""")
def snk_question_files(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    k = F.col("c_custkey")
    q = read(spark, d, "customer").select(F.when(k % 2 == 0, "MCQ").otherwise("TF").alias("q_type"), F.concat(F.lit("Where is\n"), "c_name", F.lit("?")).alias("question"), F.lit(1).alias("hop_count"), F.lit("[]").alias("reasoning_path"), F.lit("Normal").alias("variant_type"), F.when(k % 2 == 0, "A").otherwise(F.when(k % 3 == 0, "True").otherwise("False")).alias("answer"))
    writers.questions(q, at)
    both = [readers.csv_pair(spark, f"{at}/questions/q_type={t}", f"{at}/answers/q_type={t}").withColumn("q_type", F.lit(t)) for t in ("MCQ", "TF")]
    return both[0].unionByName(both[1]).select("q_type", "id", F.replace("question", F.lit("\n"), F.lit(" ")).alias("question"), "answer")


@query("""
SELECT c_nationkey AS community, c_name AS "Name", 'cus' || c_custkey AS "ID", CASE WHEN c_custkey % 2 = 0 THEN CAST(1900 + c_custkey % 90 AS VARCHAR) END AS "Birth Year" FROM customer
""")
def snk_communities(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark)
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_name").alias("name"), key("cus", "c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, 1900 + F.col("c_custkey") % 90).alias("birth_year"))
    writers.communities(c, at)
    return spark.read.csv(at, header=True).select(F.col("community").cast("int").alias("community"), "Name", "ID", "Birth Year")


@query("""
SELECT event_id AS id, event_type FROM events WHERE event_id % 3 < 2
""")
def snk_appended(spark: SparkSession, d: str) -> DataFrame:
    """Answers are appended as they come, after those that an earlier run left."""
    at = scratch(spark)
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "event_type")
    writers.append(e.where("id % 3 = 0"), at)
    done = spark.read.schema("id bigint, event_type string").json(at)
    writers.append(G.cut(readers.remaining(e.where("id % 3 < 2"), done)), at)
    return spark.read.schema("id bigint, event_type string").json(at)


def _relation(kind: str, p: patterns.Pattern):
    """The pattern query of a relation, with both ends given: customers as persons, their suppliers as what they are related to."""
    years = ", min(year(o_orderdate)) AS year_start, max(year(o_orderdate)) AS year_end" if p.properties else ""
    shown = ", CAST(year_start AS VARCHAR) AS year_start, CAST(year_end AS VARCHAR) AS year_end" if p.properties else ""

    @query(f"""
WITH x AS (SELECT c_name, s_name{years} FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY c_name, s_name)
SELECT c_name AS name, s_name AS {p.as_target}{shown} FROM x WHERE contains(lower(c_name), '#00000001') AND contains(lower(s_name), '#00000000') ORDER BY 1, 2 LIMIT {p.limits[0]}
""")
    def run(spark: SparkSession, d: str) -> DataFrame:
        line = read(spark, d, "orders").join(read(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        e = line.groupBy(key("cus", "o_custkey").alias("src"), key("sup", "l_suppkey").alias("dst")).agg(F.min(F.year("o_orderdate")).cast("string").alias("a"), F.max(F.year("o_orderdate")).cast("string").alias("b"))
        e = e.select("src", "dst", F.lit(kind).alias("type"), F.create_map(F.lit("year_start"), "a", F.lit("year_end"), "b").alias("properties"))
        n = graph(spark, d, ("LOCATED_IN",)).nodes.where("type in ('Customer', 'Supplier')").withColumn("type", F.when(F.col("type") == "Customer", "Politician").otherwise(p.target))
        return patterns.from_intent(G.PropertyGraph(n, e), kind, [{"type": "Politician", "text": "#00000001"}, {"type": p.target, "text": "#00000000"}])

    return run


def _register() -> None:
    from tessera.plans import tables

    for kind in ("DIED_AT", "HAS_RANK", "ALUMNUS_OF", "AWARDED", "SERVED_IN", "FOUGHT_IN", "HAS_ACADEMIC_TITLE"):
        _relation(kind, patterns.PATTERNS[kind])
        for registry in (tables.QUERIES, tables.SQL):
            registry[f"pq_{kind.lower()}"] = registry.pop("run")


_register()


_RESULTS = "SELECT CASE WHEN o_custkey % 3 = 0 THEN 'TRUE_FALSE' ELSE 'MCQ' END AS q_type, 1 + o_custkey % 4 AS hop, CASE o_orderpriority WHEN '5-LOW' THEN 'Paraphrase' ELSE 'Normal' END AS variant, o_orderstatus AS y_true, CASE WHEN o_totalprice % 7 >= 6 THEN NULL WHEN o_totalprice % 7 >= 4 THEN 'F' ELSE o_orderstatus END AS y_pred FROM orders"


@query(f"""
WITH r AS ({_RESULTS}), c AS (SELECT *, CAST(y_true = y_pred AS INTEGER) AS ok FROM r),
h AS (SELECT q_type, hop, count(*) AS n, coalesce(sum(ok), 0) AS k FROM c GROUP BY ALL), v AS (SELECT q_type, variant, count(*) AS n, coalesce(sum(ok), 0) AS k FROM c GROUP BY ALL)
SELECT q_type, count(*) AS total, sum(ok) AS correct, count(*) FILTER (WHERE ok = 0) AS incorrect, count(*) FILTER (WHERE y_pred IS NULL) AS no_response, round(100.0 * sum(ok) / count(*), 6) AS accuracy, round(100.0 * sum(ok) / count(y_pred), 6) AS answered_accuracy,
  (SELECT string_agg(hop || ':' || n || ':' || CAST(k AS BIGINT), ',' ORDER BY hop) FROM h WHERE h.q_type = c.q_type) AS by_hop, (SELECT string_agg(variant || ':' || n || ':' || CAST(k AS BIGINT), ',' ORDER BY variant) FROM v WHERE v.q_type = c.q_type) AS by_variant
FROM c GROUP BY q_type
""")
def snk_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of an evaluation's files, read back."""
    at, rest = scratch(spark), F.col("o_totalprice") % 7
    pred = F.when(rest >= 6, None).when(rest >= 4, "F").otherwise(F.col("o_orderstatus"))
    variant = F.when(F.col("o_orderpriority") == "5-LOW", "Paraphrase").otherwise("Normal")
    writers.evaluation(read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "TRUE_FALSE").otherwise("MCQ").alias("q_type"), (1 + F.col("o_custkey") % 4).alias("hop_count"), variant.alias("variant_type"), F.col("o_orderstatus").alias("y_true"), pred.alias("y_pred")), at)
    cell = "array<struct<key:string,total:bigint,correct:bigint>>"
    s = spark.read.schema(f"q_type string, total bigint, correct bigint, incorrect bigint, no_response bigint, accuracy double, metrics struct<accuracy:double>, by_hop {cell}, by_variant {cell}").json(f"{at}/statistics")
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["key"], x["total"].cast("string"), x["correct"].cast("string"))), ",")
    return s.select("q_type", "total", "correct", "incorrect", "no_response", F.round("accuracy", 6).alias("accuracy"), F.round("metrics.accuracy", 6).alias("answered_accuracy"), flat("by_hop").alias("by_hop"), flat("by_variant").alias("by_variant"))
