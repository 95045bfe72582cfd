"""Queries of community profiles, rankings, lookups and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import access, algorithms, graph as G, profiles
from tessera.plans.graph_queries import trade
from tessera.plans.tables import E, N, edges, graph, key, nodes, query, read


def _members(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("community"), key("cus", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).alias("party"))


@query("""
WITH m AS (SELECT c_nationkey AS community, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment ELSE 'none' END AS party FROM customer)
SELECT community, party, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY community), 2) AS percentage FROM m GROUP BY community, party
""")
def agg_party_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profiles.distribution(_members(spark, d), "party", "none")


@query("""
WITH m AS (SELECT c_nationkey AS community, c_custkey FROM customer), z AS (SELECT community, count(*) AS size FROM m GROUP BY community),
c AS (SELECT community, 'Supplier' AS type, s_name AS name, count(DISTINCT c_custkey) AS count FROM m JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL
      UNION ALL SELECT community, 'Part', p_name, count(DISTINCT c_custkey) FROM m JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY community, p_name)
SELECT c.*, count(*) OVER (PARTITION BY c.community, type) AS total, row_number() OVER (PARTITION BY c.community, type ORDER BY count DESC, name) AS rank, round(100.0 * count / size, 2) AS percentage FROM c JOIN z ON z.community = c.community QUALIFY rank <= 10
""")
def agg_connected_nodes(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = line.select(key("cus", "o_custkey").alias("src"), F.explode(F.array(key("sup", "l_suppkey"), key("par", "l_partkey"))).alias("dst"))
    return profiles.connected(_members(spark, d), e, nodes(spark, d))


@query("""
SELECT c_nationkey AS community, min(year(o_orderdate)) AS first, max(year(o_orderdate)) AS last, round(avg(year(o_orderdate)), 1) AS mean, count(*) AS count FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey
""")
def agg_term_years(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("community"), F.concat(F.lit("từ ngày "), F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date"))
    return profiles.years(t)


@query("""
WITH w AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
x AS (SELECT c_nationkey AS community, c, s FROM w JOIN customer ON c_custkey = c JOIN supplier ON s_suppkey = s WHERE c_nationkey = s_nationkey),
g AS (SELECT community, 'cus' || c AS id, count(*) AS degree FROM x GROUP BY ALL UNION ALL SELECT community, 'sup' || s, count(*) FROM x GROUP BY ALL),
n AS (SELECT 'cus' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'sup' || s_suppkey, s_name FROM supplier)
SELECT community, g.id, name, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, g.id) AS rank FROM g JOIN n ON n.id = g.id QUALIFY rank <= 10
""")
def ord_central_members(spark: SparkSession, d: str) -> DataFrame:
    w, c = trade(spark, d)
    return profiles.central_members(w, c.join(nodes(spark, d).select("id", "name"), "id"))


@query(f"""
WITH {N}, {E}, g AS (SELECT id, count(*) FILTER (WHERE k = 'i') AS i, count(*) AS t FROM (SELECT src AS id, 'o' AS k FROM e UNION ALL SELECT dst, 'i' FROM e) GROUP BY id),
s AS (SELECT 'in' AS measure, n.id, name, type, coalesce(i, 0) AS score FROM n LEFT JOIN g ON g.id = n.id UNION ALL SELECT 'total', n.id, name, type, coalesce(t, 0) FROM n LEFT JOIN g ON g.id = n.id),
z AS (SELECT *, 'all' AS of FROM s UNION ALL SELECT *, type FROM s WHERE type IN ('Customer', 'Supplier'))
SELECT measure, of, row_number() OVER (PARTITION BY measure, of ORDER BY score DESC, id) AS rank, id, name, type, score FROM z QUALIFY rank <= 20
""")
def ord_rankings(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    degrees = algorithms.degrees(g.nodes, g.edges)
    return profiles.rankings(g.nodes, {"in": (degrees, "in_degree"), "total": (degrees, "total")}, types=("Customer", "Supplier"))


@query(f"""
WITH {E} SELECT src, dst, type FROM e JOIN (SELECT 'ord' || o_orderkey AS a, 'sup' || (o_orderkey % 20) AS b FROM orders) p ON p.a = e.src AND p.b = e.dst
""")
def ga_edges_between(spark: SparkSession, d: str) -> DataFrame:
    pairs = read(spark, d, "orders").select(key("ord", "o_orderkey").alias("src"), F.concat(F.lit("sup"), (F.col("o_orderkey") % 20).cast("string")).alias("dst"))
    return access.edges_between(graph(spark, d), pairs).select("src", "dst", "type")


@query(f"""
WITH {E} SELECT DISTINCT src AS start, type, dst AS id FROM e WHERE src LIKE 'ord%' AND type IN ('SUPPLIED_BY', 'CONTAINS') AND dst LIKE 'sup%'
""")
def ga_neighbours(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return access.neighbours(g, access.nodes_by_type(g, ["Order"]), ["SUPPLIED_BY", "CONTAINS"], ["Supplier"])


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 4 THEN 'Không đủ thông tin' WHEN n_nationkey = (c_nationkey + c_custkey % 2) % 25 THEN CASE c_custkey % 2 WHEN 0 THEN 'Đúng' ELSE 'Sai' END END AS answer
FROM customer JOIN nation ON n_nationkey = (c_nationkey + c_custkey % 2) % 25
""")
def wf_truth_answers(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    c = read(spark, d, "customer").join(n, (F.col("c_nationkey") + F.col("c_custkey") % 2) % 25 == F.col("n_nationkey"))
    claims = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), F.upper("c_name")).alias("subject"), F.lit("LOCATED_IN").alias("type"), F.when(F.col("c_custkey") % 5 == 4, "Nowhere").otherwise(F.lower("n_name")).alias("object"))
    return access.truth_answers(claims, graph(spark, d, ("LOCATED_IN",)))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 4 THEN ['A', 'B', 'C', 'D'][c_custkey % 5 + 1] END AS answer FROM customer
""")
def wf_choice_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer stands at a place that goes round; every fifth question has it nowhere."""
    n = read(spark, d, "nation")
    c = read(spark, d, "customer")
    option = lambda i: n.select((F.col("n_nationkey")).alias(f"k{i}"), F.col("n_name").alias(f"n{i}"))
    for i in range(4):
        c = c.join(option(i), (F.col("c_nationkey") + (F.lit(i) - F.col("c_custkey") % 5 + 25)) % 25 == F.col(f"k{i}"))
    q = F.concat(F.lit("Where is it? A. "), "n0", F.lit(" B) "), "n1", F.lit(" C. "), "n2", F.lit(" D) "), "n3")
    rows = c.select(F.col("c_custkey").alias("id"), q.alias("question"), F.lit("LOCATED_IN").alias("type"), F.col("c_name").alias("name"), F.lit(True).alias("forward"))
    return access.choice_answers(rows, graph(spark, d, ("LOCATED_IN",)))


@query(f"""
WITH {E}, p AS (SELECT 1 AS hop_count, type AS pattern FROM e UNION ALL SELECT 2, 'PLACED|' || y.type FROM e x JOIN e y ON y.src = x.dst WHERE x.type = 'PLACED')
SELECT hop_count, pattern, count(*) AS n, row_number() OVER (PARTITION BY hop_count ORDER BY count(*) DESC, pattern) AS rank FROM p GROUP BY hop_count, pattern QUALIFY rank <= 3
""")
def ord_common_patterns(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d).select("src", "type", "dst")
    one = e.select(F.concat_ws(" -> ", "src", "type", "dst").alias("reasoning_path"))
    two = e.where("type = 'PLACED'").toDF("a", "t", "src").join(e, "src").select(F.concat_ws("|", "a", "t", "src", "type", "dst").alias("reasoning_path"))
    return access.pattern_counts(one.unionByName(two), 3)


@query("""
SELECT count(*) FILTER (WHERE trim(n) <> '') AS processed, 0 AS changed, count(*) FILTER (WHERE trim(n) <> '' AND x = 0) AS removed, count(*) FILTER (WHERE trim(n) <> '' AND x > 0) AS kept
FROM (SELECT p_name AS n, p_partkey % 3 AS x FROM part)
""")
def agg_transform_counts(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", "p_name")
    return access.transform_counts(p, p.withColumn("p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name"))), "p_partkey", "p_name")


@query("""
SELECT 'TERM_DURATION' AS type, count(*) AS n FROM orders UNION ALL SELECT 'BORN_YEAR', count(*) FROM customer UNION ALL SELECT 'TERMS', count(*) FROM orders
""")
def agg_virtual_counts(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.question_queries import gb_virtual_edges

    return access.virtual_counts(gb_virtual_edges(spark, d), edges(spark, d))


@query("""
SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 = 0 OR 1850 + (c_custkey * 7) % 120 >= 1900
""")
def flt_born_since(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    date = F.when(F.col("c_custkey") % 4 > 0, F.concat((1850 + (F.col("c_custkey") * 7) % 120).cast("string"), F.lit("-03-04")))
    n = c.select(F.col("c_custkey").alias("id"), F.map_filter(F.create_map(F.lit("birth_date"), date), lambda _, v: v.isNotNull()).alias("properties"))
    return access.born_since(n).select("id")
