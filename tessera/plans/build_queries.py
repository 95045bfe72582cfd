"""Queries of the graph build, enrichment and question candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators import build, candidates, graph as G, records as R
from tessera.plans.tables import E, N, edges, graph, key, mixed, nodes, query, read

_H = "(({0} * 2654435761) % 4294967296)"


def _name(number) -> F.Column:
    return F.concat(F.lit("Customer#"), F.lpad(number.cast("string"), 9, "0"))


def person_records(spark: SparkSession, d: str) -> DataFrame:
    """A record for each customer: its orders are its offices (a record has 14), which name others as predecessors and successors."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.concat(F.lit("Office of "), "o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("office"))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = o.withColumn("slot", n).where(F.col("slot") <= R.SLOTS)
    number = F.when(F.col("slot") == 1, "").otherwise(F.col("slot").cast("string"))
    other = lambda k: _name((F.col("o_custkey") * k + F.col("slot")) % 200)
    fields = [("office", F.col("office")), ("term_start", F.date_format("o_orderdate", "yyyy-MM-dd")), ("predecessor", F.concat(F.lit("[["), other(7), F.lit("|before]]"))), ("successor", F.concat(other(3), F.lit(", "), other(5)))]
    entries = F.array(*[F.struct(F.concat(F.lit(k), number).alias("k"), v.alias("v")) for k, v in fields])
    boxes = o.select(F.col("o_custkey").alias("id"), F.inline(entries)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("offices"))
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("officeholder").alias("template"), F.create_map(F.lit("birth_place"), F.col("n_name")).alias("born"))
    empty = F.expr("cast(map() as map<string,string>)")
    return R.with_lists(c.join(boxes, "id", "left").select("title", "id", "template", F.map_concat("born", F.coalesce("offices", empty)).alias("infobox")))


_BUILT = """
t AS (SELECT o_custkey AS rec, 'Office of ' || o_orderstatus || substr(o_orderpriority, 1, 1) AS office, strftime(o_orderdate, '%Y-%m-%d') AS ts, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS slot FROM orders QUALIFY slot <= 14),
m AS (SELECT rec, slot AS ord, 'Position' AS label, 'pos' AS prefix, office AS name FROM t UNION ALL SELECT c_custkey, 100, 'Location', 'loc', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
f AS (SELECT label, prefix, lower(name) AS k, min(rec * 1000 + ord) AS o, arg_min(name, rec * 1000 + ord) AS name FROM m GROUP BY ALL),
i AS (SELECT label, k, name, prefix || (o // 1000) || '_' || lpad(CAST(row_number() OVER (PARTITION BY prefix, o // 1000 ORDER BY o, label, k) AS VARCHAR), 3, '0') AS id FROM f),
s AS (SELECT t.rec, t.slot, i.id, t.ts FROM t JOIN i ON i.label = 'Position' AND i.k = lower(t.office))"""


@query(f"""
WITH {_BUILT}
SELECT 'pol' || rec AS src, id AS dst, 'SERVED_AS' AS type, CAST(NULL AS VARCHAR) AS position_id, ts AS term_start FROM s
UNION ALL SELECT 'pol' || c_custkey, i.id, 'BORN_AT', NULL, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN i ON i.label = 'Location' AND i.k = lower(n_name)
UNION ALL SELECT 'pol' || s.rec, 'pol' || c_custkey, 'SUCCEEDED', s.id, NULL FROM s JOIN customer ON c_custkey = (s.rec * 7 + s.slot) % 200
UNION ALL SELECT 'pol' || s.rec, 'pol' || c_custkey, 'PRECEDED', s.id, NULL FROM s JOIN customer ON c_custkey = (s.rec * 3 + s.slot) % 200
UNION ALL SELECT 'pol' || s.rec, 'pol' || c_custkey, 'PRECEDED', s.id, NULL FROM s JOIN customer ON c_custkey = (s.rec * 5 + s.slot) % 200
""")
def gb_build_edges(spark: SparkSession, d: str) -> DataFrame:
    of = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return build.build(person_records(spark, d)).edges.select("src", "dst", "type", of("position_id"), of("term_start"))


@query(f"""
WITH {_BUILT}
SELECT 'pol' || c_custkey AS id, 'Politician' AS type, c_name AS name, '{C.DEFAULT_PARTY}' AS party FROM customer
UNION ALL SELECT id, label, name, NULL FROM i
""")
def gb_build_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = build.build(person_records(spark, d))
    return g.nodes.select("id", "type", "name", F.try_element_at("properties", F.lit("party")).alias("party"))


#: What a customer's record says, as a column each: half of the records use the other names of the fields.
_SAID = [
    ("birth_place", "nơi_sinh", "n_name"), ("death_place", "nơi_chết", "concat('Town ', c_nationkey)"), ("branch", "branch", "c_mktsegment"), ("military_rank", "cấp_bậc", "concat('Rank ', n_regionkey)"),
    ("years_of_service", "năm_phục_vụ", "concat(1940 + c_nationkey, ' – ', 1960 + n_regionkey)"), ("awards", "khen_thưởng", "concat('Order ', c_mktsegment)"), ("alma_mater", "trường", "concat('School of ', n_name)"),
    ("education", "trình_độ", "concat('Doctor ', c_mktsegment)"), ("honorific_prefix", "honorific_prefix", "concat('General ', n_regionkey, ', Sir')"), ("battles", "battles", "concat('Battle of ', n_name)"), ("office", "office", "concat('Office of ', c_mktsegment)"),
]


@query("""
WITH c AS (SELECT *, 'pol' || c_custkey AS id FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id AS src, 'BORN_AT' AS type, n_name AS name, CAST(NULL AS VARCHAR) AS year_start, CAST(NULL AS VARCHAR) AS year_end FROM c
UNION ALL SELECT id, 'DIED_AT', 'Town ' || c_nationkey, NULL, NULL FROM c
UNION ALL SELECT id, 'SERVED_IN', c_mktsegment, CAST(1940 + c_nationkey AS VARCHAR), CAST(1960 + n_regionkey AS VARCHAR) FROM c
UNION ALL SELECT id, 'HAS_RANK', 'Rank ' || n_regionkey, NULL, NULL FROM c
UNION ALL SELECT id, 'AWARDED', 'Order ' || c_mktsegment, NULL, NULL FROM c
UNION ALL SELECT id, 'ALUMNUS_OF', 'School of ' || n_name, NULL, NULL FROM c
UNION ALL SELECT id, 'HAS_ACADEMIC_TITLE', unnest(['Doctor ' || c_mktsegment, 'General ' || n_regionkey, 'Sir']), NULL, NULL FROM c
UNION ALL SELECT id, 'FOUGHT_IN', 'Battle of ' || n_name, NULL, NULL FROM c
UNION ALL SELECT id, 'SERVED_AS', 'Office of ' || c_mktsegment, NULL, NULL FROM c
UNION ALL SELECT p.id, x.type, s.c_name, NULL, NULL FROM c p CROSS JOIN (VALUES ('SUCCEEDED', 7), ('PRECEDED', 3)) x(type, f) JOIN customer s ON s.c_custkey = (p.c_custkey * x.f + 1) % 200
""")
def gb_all_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every type of edge, from records whose fields have either of their names."""
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    other = F.col("c_custkey") % 2 == 1
    fields = [F.struct(F.when(other, b).otherwise(a).alias("k"), F.expr(x).cast("string").alias("v")) for a, b, x in _SAID]
    fields += [F.struct(F.lit(k).alias("k"), _name((F.col("c_custkey") * f + 1) % 200).alias("v")) for k, f in (("predecessor", 7), ("successor", 3))]
    records = c.select(F.col("c_name").alias("title"), F.col("c_custkey").alias("id"), F.lit("officeholder").alias("template"), F.map_from_entries(F.array(*fields)).alias("infobox"))
    g = build.build(R.with_lists(records))
    of = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return g.edges.join(g.nodes.select(F.col("id").alias("dst"), "name"), "dst").select("src", "type", "name", of("year_start"), of("year_end"))


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """What a model could have found: each supplier's region as an award, and its parts' brands as positions."""
    l = read(spark, d, "lineitem").join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    position = F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("term_start"), F.lit("").alias("status"))
    p = l.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(position)).alias("positions"))
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    award = F.array(F.struct(F.lower("n_name").alias("name"), F.lit("1999").alias("year")))
    return s.join(p, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(key("sup", "s_suppkey").alias("person"), F.struct("positions", award.alias("awards")).alias("answer"))


@query("""
WITH b AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'Position' AS label, count(*) AS mentions, count(DISTINCT p_brand) AS nodes, count(*) AS edges FROM b
UNION ALL SELECT 'Award', count(*), 0, count(*) FILTER (WHERE s_suppkey % 2 = 0) FROM supplier
""")
def gb_enrich_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nations are known awards; suppliers of odd numbers have theirs already."""
    awards = read(spark, d, "nation").select(key("awa", "n_nationkey").alias("id"), F.lit("Award").alias("type"), F.col("n_name").alias("name"))
    none = F.expr("cast(map() as map<string,string>)")
    n = nodes(spark, d).where("type = 'Supplier'").unionByName(awards).withColumn("properties", none)
    have = read(spark, d, "supplier").where("s_suppkey % 2 = 1").select(key("sup", "s_suppkey").alias("src"), key("awa", "s_nationkey").alias("dst"), F.lit("AWARDED").alias("type"), none.alias("properties"))
    _, log = build.enriched(G.PropertyGraph(n, have), _extractions(spark, d))
    return build.log_counts(log)


@query("""
WITH b AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT 'SERVED_AS' AS type, p_brand AS name, count(*) AS n FROM b GROUP BY p_brand
UNION ALL SELECT 'AWARDED', n_name, count(*) FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name
""")
def gb_enrich_edges(spark: SparkSession, d: str) -> DataFrame:
    awards = read(spark, d, "nation").select(key("awa", "n_nationkey").alias("id"), F.lit("Award").alias("type"), F.col("n_name").alias("name"))
    none = F.expr("cast(map() as map<string,string>)")
    n = nodes(spark, d).where("type = 'Supplier'").unionByName(awards).withColumn("properties", none)
    have = read(spark, d, "supplier").where("s_suppkey % 2 = 1").select(key("sup", "s_suppkey").alias("src"), key("awa", "s_nationkey").alias("dst"), F.lit("AWARDED").alias("type"), none.alias("properties"))
    g, _ = build.enriched(G.PropertyGraph(n, have), _extractions(spark, d))
    return g.edges.join(g.nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy("type", "name").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {E}, {N},
w AS (SELECT src, type, dst, least(count(*), 2) AS n FROM e WHERE type NOT IN ('SUCCEEDED', 'PRECEDED') AND src <> dst GROUP BY src, type, dst)
SELECT type, sum(n) AS candidates, count(*) AS paths FROM w GROUP BY type
""")
def gen_one_hop(spark: SparkSession, d: str) -> DataFrame:
    found = candidates.one_hop(graph(spark, d))
    return found.groupBy(F.col("path")[1].alias("type")).agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("path").alias("paths"))


@query(f"""
WITH {E},
h AS (SELECT DISTINCT src, dst FROM e WHERE type = 'SUPPLIED_BY')
SELECT x.src, x.dst, x.type, min(a.dst) AS position_id FROM e x JOIN h a ON a.src = x.src JOIN h b ON b.src = x.dst AND b.dst = a.dst WHERE x.type IN ('SUCCEEDED', 'PRECEDED') GROUP BY ALL
""")
def gen_common_positions(spark: SparkSession, d: str) -> DataFrame:
    served = edges(spark, d, ("SUPPLIED_BY",)).select(F.col("src").alias("holder"), F.col("dst").alias("position"))
    return candidates.common_positions(edges(spark, d, ("SUCCEEDED", "PRECEDED")), served)


@query(f"""
WITH {E},
c AS (SELECT src AS a, dst AS b, dst AS last, src || '|SUCCEEDED|' || dst AS path, 1 AS k FROM e WHERE type = 'SUCCEEDED'
      UNION ALL SELECT x.src, y.src, y.dst, x.src || '|SUCCEEDED|' || y.src || '|SUCCEEDED|' || y.dst, 2 FROM e x JOIN e y ON y.src = x.dst AND y.type = 'SUCCEEDED' WHERE x.type = 'SUCCEEDED' AND y.dst <> x.src),
t AS (SELECT DISTINCT src, dst, type FROM e WHERE type IN ('SUPPLIED_BY', 'CONTAINS')),
p AS (SELECT c.path || '|' || t.type || '|' || t.dst AS path, c.k + 1 AS hop_count, t.type FROM c JOIN t ON t.src = c.last)
SELECT path, hop_count FROM p QUALIFY row_number() OVER (PARTITION BY hop_count, type ORDER BY path) <= 300
""")
def gen_dead_ends(spark: SparkSession, d: str) -> DataFrame:
    followed = edges(spark, d, ("SUCCEEDED",)).withColumn("position_id", F.try_element_at("properties", F.lit("position_id")))
    served = edges(spark, d, ("PLACED",)).select(F.col("dst").alias("holder"), F.col("src").alias("position"))
    found = candidates.dead_ends(followed, served, edges(spark, d, ("SUPPLIED_BY", "CONTAINS")), 2)
    return found.select(candidates.signature(F.col("path")).alias("path"), "hop_count")


_ENDING = lambda names, key: "[" + ", ".join(f"'{x}'" for x in names) + f"][{key} % {len(names)} + 1]"


@query(f"""
WITH c AS (SELECT c_custkey AS id, c_name AS a, n.n_name AS b, f.n_name AS fb, 'Customer#' || lpad(CAST(c_custkey % 100 + 1 AS VARCHAR), 9, '0') AS fa, {_H.format('c_custkey')} AS h FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation f ON f.n_nationkey = (c_nationkey + 1) % 25),
q AS (SELECT id, direction, kind, h + salt AS k,
        CASE WHEN kind = 'TF_FALSE' AND direction = 'backward' THEN fa ELSE a END AS a, CASE WHEN kind = 'TF_FALSE' AND direction = 'forward' THEN fb ELSE b END AS b, a AS a0, b AS b0
      FROM c CROSS JOIN (VALUES ('forward', 'TF_TRUE', 0), ('forward', 'TF_FALSE', 7), ('forward', 'MCQ', 14), ('backward', 'TF_TRUE', 21), ('backward', 'TF_FALSE', 28), ('backward', 'MCQ', 35)) v(direction, kind, salt)),
x AS (SELECT *, kind <> 'MCQ' AND k % 10 >= 7 AS neg FROM q)
SELECT id, direction, kind,
  CASE WHEN kind = 'MCQ' AND direction = 'forward' THEN a || ' sinh ra ở đâu?' WHEN kind = 'MCQ' THEN b || ' là quê của ai?'
       ELSE CASE direction WHEN 'forward' THEN a || ' sinh ra ở ' || b ELSE b || ' là quê của ' || a END || '. ' || CASE WHEN neg THEN {_ENDING(C.NEGATIVE_ENDINGS, 'k')} ELSE {_ENDING(C.POSITIVE_ENDINGS, 'k')} END END AS question,
  CASE WHEN kind = 'MCQ' THEN CASE direction WHEN 'forward' THEN b0 ELSE a0 END WHEN (kind = 'TF_TRUE') <> neg THEN 'Đúng' ELSE 'Sai' END AS answer FROM x
""")
def gen_pattern_questions(spark: SparkSession, d: str) -> DataFrame:
    c, n = read(spark, d, "customer"), read(spark, d, "nation")
    near = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("wrong"))
    e = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(near, (F.col("c_nationkey") + 1) % 25 == F.col("k"))
    e = e.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("src_name"), F.lit("BORN_AT").alias("type"), F.col("n_name").alias("dst_name"), F.lit(None).cast("string").alias("position_name"), "wrong")
    return candidates.pattern_questions(e, F.col("wrong"), _name(F.col("id") % 100 + 1), mixed("id"))


@query(f"""
WITH {E}, {N},
v AS (SELECT * FROM n WHERE name <> ''),
w AS (SELECT src, dst, type FROM e WHERE type IN ('LOCATED_IN'))
SELECT s.name AS src_name, 'BORN_AT' AS type, d.name AS dst_name, CAST(NULL AS VARCHAR) AS position_name FROM w JOIN v s ON s.id = w.src JOIN v d ON d.id = w.dst
UNION ALL
SELECT s.name, x.type, d.name, p.name FROM (SELECT x.src, x.dst, x.type, min(a.dst) AS p FROM e x JOIN (SELECT DISTINCT src, dst FROM e WHERE type = 'SUPPLIED_BY') a ON a.src = x.src JOIN (SELECT DISTINCT src, dst FROM e WHERE type = 'SUPPLIED_BY') b ON b.src = x.dst AND b.dst = a.dst WHERE x.type IN ('SUCCEEDED', 'PRECEDED') GROUP BY ALL) x
  JOIN v s ON s.id = x.src JOIN v d ON d.id = x.dst JOIN v p ON p.id = x.p
UNION ALL SELECT s.name, 'SERVED_AS', d.name, NULL FROM e JOIN v s ON s.id = e.src JOIN v d ON d.id = e.dst WHERE e.type = 'SUPPLIED_BY'
""")
def gen_all_facts(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("type") == "LOCATED_IN", "BORN_AT").when(F.col("type") == "SUPPLIED_BY", "SERVED_AS").otherwise(F.col("type"))
    g = graph(spark, d, ("LOCATED_IN", "SUPPLIED_BY", "SUCCEEDED", "PRECEDED"))
    return candidates.all_facts(G.PropertyGraph(g.nodes, g.edges.withColumn("type", kinds)))


def _trade(spark: SparkSession, d: str) -> G.PropertyGraph:
    return graph(spark, d, ("LOCATED_IN", "IN_REGION", "PLACED", "CONTAINS", "SUPPLIED_BY", "SUCCEEDED"))


_CAPPED = {k: f"(SELECT DISTINCT src, dst, type FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_id) AS i FROM e) WHERE i <= {n} AND src <> dst)" for k, n in (("d3", 15), ("d4", 10))}


@query(f"""
WITH {E}, d3 AS MATERIALIZED {_CAPPED["d3"]}, d4 AS MATERIALIZED {_CAPPED["d4"]}, d AS MATERIALIZED (SELECT DISTINCT src, dst, type FROM e WHERE src <> dst),
p2 AS (SELECT concat_ws('|', x.src, x.type, x.dst, y.type, y.dst) AS path FROM d x JOIN d y ON y.src = x.dst AND y.dst <> x.src WHERE x.src LIKE 'cus%'),
p3 AS (SELECT concat_ws('|', x.src, x.type, x.dst, y.type, y.dst) AS half, concat_ws('|', half, z.type, z.dst) AS path FROM d3 x JOIN d3 y ON y.src = x.dst AND y.dst <> x.src JOIN d3 z ON z.src = y.dst AND z.dst NOT IN (x.src, x.dst)),
p4 AS (SELECT concat_ws('|', x.src, x.type, x.dst, y.type, y.dst) AS half, concat_ws('|', half, z.type, z.dst, w.type, w.dst) AS path FROM d4 x JOIN d4 y ON y.src = x.dst AND y.dst <> x.src JOIN d4 z ON z.src = y.dst AND z.dst NOT IN (x.src, x.dst) JOIN d4 w ON w.src = z.dst AND w.dst NOT IN (x.src, x.dst, y.dst))
SELECT path, 2 AS hop_count FROM p2
UNION ALL (SELECT path, 3 FROM p3 ORDER BY md5('42|' || half), md5('42|' || path) LIMIT 3000)
UNION ALL (SELECT path, 4 FROM p4 ORDER BY md5('42|' || half), md5('42|' || path) LIMIT 1500)
""")
def gen_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    """All paths of two edges from customers, and the first 3,000 of three and 1,500 of four over all types of edges, cycles too."""
    g = graph(spark, d)
    caps = {2: (None, None), 3: (15, 3000), 4: (10, 1500)}
    starts = g.nodes.where("type = 'Customer'").select("id")
    out = None
    for hops, (width, most) in caps.items():
        own = candidates.exhaustive(g, hops, width, most, starts if hops == 2 else None)
        out = own if out is None else out.unionByName(own)
    return out.select(F.array_join("path", "|").alias("path"), "hop_count")


@query()
def gen_shortest_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Shortest paths from every customer to nodes drawn for it (tested against brute force)."""
    g = _trade(spark, d)
    served = edges(spark, d, ("PLACED",)).select(F.col("dst").alias("holder"), F.col("src").alias("position"))
    pairs = G.cut(candidates.drawn_pairs(g.nodes, 100, 42).where("start like 'cus%'"))
    return candidates.shortest_candidates(g, pairs, served).select(candidates.signature(F.col("path")).alias("path"), "hop_count")


@query(f"""
WITH {E},
a AS (SELECT count(*) AS n FROM (SELECT DISTINCT src, dst FROM e WHERE type IN ('LOCATED_IN', 'IN_REGION'))),
t AS (SELECT DISTINCT src, dst, type FROM e WHERE type IN ('SUPPLIED_BY', 'CONTAINS')),
c AS (SELECT dst AS last, 2 AS k FROM e WHERE type = 'SUCCEEDED' UNION ALL SELECT y.dst, 3 FROM e x JOIN e y ON y.src = x.dst AND y.type = 'SUCCEEDED' WHERE x.type = 'SUCCEEDED'),
p AS (SELECT k, type, least(count(*), 300) AS n FROM c JOIN t ON t.src = c.last GROUP BY k, type),
b AS (SELECT k, sum(n) AS n FROM p GROUP BY k),
one AS (SELECT least(100, n) AS n FROM a),
two AS (SELECT least(200 + 100 - (SELECT n FROM one), b.n) AS n, 200 + 100 - (SELECT n FROM one) - least(200 + 100 - (SELECT n FROM one), b.n) AS rest FROM b WHERE k = 2),
three AS (SELECT least(120 + (SELECT rest FROM two), b.n) AS n FROM b WHERE k = 3)
SELECT h AS hop_count, n, (n + 1) // 2 AS choice FROM (SELECT 1 AS h, n FROM one UNION ALL SELECT 2, n FROM two UNION ALL SELECT 3, n FROM three)
""")
def gen_quota_mix(spark: SparkSession, d: str) -> DataFrame:
    """500 questions of one to three hops, from single edges and chains that end in an edge."""
    g = graph(spark, d, ("LOCATED_IN", "IN_REGION"))
    followed = edges(spark, d, ("SUCCEEDED",)).withColumn("position_id", F.try_element_at("properties", F.lit("position_id")))
    served = edges(spark, d, ("PLACED",)).select(F.col("dst").alias("holder"), F.col("src").alias("position"))
    chains = candidates.dead_ends(followed, served, edges(spark, d, ("SUPPLIED_BY", "CONTAINS")), 2)
    every = candidates.gathered([candidates.one_hop(g), chains], 7)
    out = candidates.quota_mix(every, 500)
    return out.groupBy("hop_count").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "MCQ").alias("choice"))


@query("""
WITH x AS (SELECT s_suppkey AS k, s_suppkey % 7 = 0 AS short, s_suppkey % 5 = 1 AS none, s_suppkey % 5 = 2 AS bad, CASE WHEN s_suppkey % 5 = 1 THEN 0 WHEN s_suppkey % 5 = 2 THEN 2 ELSE 1 + s_suppkey % 3 END AS tries FROM supplier),
y AS (SELECT CASE WHEN short THEN 'short' WHEN none THEN 'waiting' WHEN bad THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN short THEN 0 ELSE tries END AS attempts FROM x)
SELECT status, attempts, count(*) AS records, count(*) FILTER (WHERE status = 'extracted') AS awards FROM y GROUP BY status, attempts
""")
def gb_extraction_stage(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's summary, and the responses for it: none, failed calls and broken replies, or a good one after up to two of those."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    records = s.select(k.alias("id"), F.when(k % 7 == 0, "short").otherwise(F.concat("s_name", F.lit(" was given the award of "), "n_name", F.lit(" in the year 1999."))).alias("summary"))
    good = F.concat(F.lit("```json\n{\"awards\": [{\"name\": \""), "n_name", F.lit("\", \"year\": \"1999\"},]}\n```"))
    tries = F.when(k % 5 == 1, 0).when(k % 5 == 2, 2).otherwise(1 + k % 3).cast("int")
    attempts = s.where(tries > 0).select("*", tries.alias("tries"), F.explode(F.sequence(F.lit(1), tries)).alias("attempt"))
    reply = F.when((F.col("attempt") == F.col("tries")) & (k % 5 != 2), good).when(F.col("attempt") == 1, None).otherwise("I can't say.")
    found = build.extraction_stage(records, attempts.select(k.alias("record_id"), "attempt", reply.alias("reply")))
    return found.groupBy("status", "attempts").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.size("answer.awards")), F.lit(0)).alias("awards"))
