"""Queries of question generation, sampling and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation, graph as G, paths, patterns, questions as Q
from tessera.plans.tables import O, edges, graph, key, mixed, nodes, query, read

_H = "(({0} * 2654435761) % 4294967296)"


@query(f"""
WITH x AS (SELECT doc_id, quality AS y_true, CASE WHEN {_H.format('doc_id')} % 10 < 7 THEN quality WHEN {_H.format('doc_id')} % 10 < 9 THEN 1 - quality END AS y_pred, 1 + doc_id % 3 AS hop FROM labels),
c AS (SELECT hop, l AS label, count(*) FILTER (WHERE y_true = l AND y_pred = l) AS tp, count(*) FILTER (WHERE y_pred = l) AS said, count(*) FILTER (WHERE y_true = l) AS support FROM x CROSS JOIN (VALUES (0), (1)) v(l) GROUP BY hop, l),
p AS (SELECT *, CASE WHEN said > 0 THEN 100.0 * tp / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN 100.0 * tp / support ELSE 0 END AS re FROM c),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM p),
w AS (SELECT hop, sum(pr * support) / sum(support) AS p, sum(re * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f FROM f GROUP BY hop)
SELECT x.hop, round(100.0 * count(*) FILTER (WHERE y_true = y_pred) / count(*), 6) AS accuracy, round(any_value(w.p), 6) AS "precision", round(any_value(w.r), 6) AS recall, round(any_value(w.f), 6) AS f1_score, count(*) AS total, count(*) FILTER (WHERE y_true = y_pred) AS correct
FROM x JOIN w ON w.hop = x.hop GROUP BY x.hop
""")
def agg_metrics_by_hop(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.metrics(_predicted(spark, d), ["hop"]))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    h = mixed("doc_id") % 10
    pred = F.when(h < 7, F.col("quality")).when(h < 9, 1 - F.col("quality"))
    return read(spark, d, "labels").select("doc_id", F.col("quality").alias("y_true"), pred.alias("y_pred"), (1 + F.col("doc_id") % 3).alias("hop"))


def _rounded(x: DataFrame) -> DataFrame:
    return x.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1_score")})


@query(f"""
WITH x AS (SELECT quality AS y_true, CASE WHEN {_H.format('doc_id')} % 10 < 7 THEN quality WHEN {_H.format('doc_id')} % 10 < 9 THEN 1 - quality END AS y_pred FROM labels),
c AS (SELECT l AS label, count(*) FILTER (WHERE y_true = l AND y_pred = l) AS tp, count(*) FILTER (WHERE y_pred = l) AS said, count(*) FILTER (WHERE y_true = l) AS support FROM x CROSS JOIN (VALUES (0), (1)) v(l) WHERE y_pred IS NOT NULL GROUP BY l)
SELECT label, round(100.0 * tp / said, 6) AS "precision", round(100.0 * tp / support, 6) AS recall, round(2.0 * (100.0 * tp / said) * (100.0 * tp / support) / (100.0 * tp / said + 100.0 * tp / support), 6) AS f1, support FROM c
""")
def agg_metrics_answered(spark: SparkSession, d: str) -> DataFrame:
    x = evaluation.per_class(_predicted(spark, d).where("y_pred is not null"))
    return x.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""
SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (WHERE o_orderpriority = '9-NONE') AS "9-NONE" FROM orders GROUP BY o_orderstatus
""")
def agg_contingency(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.contingency(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"])


@query("""
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (o_orderstatus, o_orderpriority), ())
""")
def agg_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey")
    return o.groupingSets([["status"], ["priority"], ["status", "priority"], []], "status", "priority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""
WITH s AS (SELECT l_discount AS x, l_tax AS y FROM lineitem)
SELECT round(avg(x), 9) AS mean_clustering, round(stddev_pop(x), 9) AS std_clustering, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high, round(avg(CAST(x >= 0.07 AS INT)), 9) AS p_clustering, round(avg(CAST(abs(y - 0.02) >= abs(0.02 - (SELECT avg(y) FROM s)) AS INT)), 9) AS p_length, round((0.07 / avg(x)) / (0.02 / avg(y)), 9) AS sigma FROM s
""")
def agg_null_model(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.rewiring import small_world

    s = read(spark, d, "lineitem").select(F.col("l_discount").alias("clustering"), F.col("l_tax").alias("mean_length"))
    r = small_world(s, 0.07, 0.02)
    out = {"mean_clustering": "mean_clustering", "std_clustering": "std_clustering", "p_clustering": "p_clustering", "p_length": "p_length", "sigma": "sigma"}
    return r.select(*[F.round(v, 9).alias(k) for k, v in out.items()], F.round(F.col("range_clustering")[0], 9).alias("low"), F.round(F.col("range_clustering")[1], 9).alias("high"))


@query("""
SELECT 'cus' || c_custkey AS src, 'YEAR_' || (1950 + c_nationkey) AS dst, 'BORN_YEAR' AS type FROM customer
UNION ALL SELECT 'cus' || o_custkey, 'DURATION_từ ' || strftime(o_orderdate, '%Y') || ' đến nay', 'TERM_DURATION' FROM orders
""")
def gb_virtual_edges(spark: SparkSession, d: str) -> DataFrame:
    persons = read(spark, d, "customer").select(key("cus", "c_custkey").alias("id"), F.concat((1950 + F.col("c_nationkey")).cast("string"), F.lit("-01-02")).alias("birth_date"), F.lit(None).cast("string").alias("death_date"))
    served = read(spark, d, "orders").select(key("cus", "o_custkey").alias("src"), F.date_format("o_orderdate", "yyyy").alias("term_start"), F.lit("nay").alias("term_end"))
    return Q.virtual_edges(persons, served).select("src", "dst", "type")


@query(f"""
WITH p AS (SELECT s_suppkey, 's' || s_suppkey AS x, row_number() OVER (ORDER BY 'sup' || s_suppkey) - 1 AS place, count(*) OVER () AS n FROM supplier),
c AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
q AS (SELECT c.l_orderkey, c.l_suppkey, p.s_suppkey AS f FROM c JOIN p ON p.place = {_H.format('(c.l_orderkey * 1000 + c.l_suppkey)')} % p.n)
SELECT l_orderkey, l_suppkey, f AS false_suppkey FROM q WHERE f <> l_suppkey AND NOT EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = q.l_orderkey AND c.l_suppkey = q.f)
""")
def gen_false_candidates(spark: SparkSession, d: str) -> DataFrame:
    facts = read(spark, d, "lineitem").select(key("ord", "l_orderkey").alias("src"), F.lit("SUPPLIED_BY").alias("type"), key("sup", "l_suppkey").alias("dst"), "l_orderkey", "l_suppkey").distinct()
    pool = Q.pools(nodes(spark, d).where("type = 'Supplier'"))
    c = facts.withColumns({"dst_type": F.lit("Supplier"), "id": F.col("l_orderkey") * 1000 + F.col("l_suppkey")})
    out = Q.false_candidates(c, pool, facts, mixed("id"))
    number = lambda x: F.substring(x, 4, 20).cast("bigint")
    return out.select(number("src").alias("l_orderkey"), number("dst").alias("l_suppkey"), number("false_dst").alias("false_suppkey"))


@query(f"""
WITH p AS (SELECT n_name, row_number() OVER (ORDER BY min('nat' || n_nationkey)) - 1 AS place, count(*) OVER () AS n FROM nation GROUP BY n_name),
c AS (SELECT c_custkey, n_name AS answer FROM customer JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT c_custkey, answer, p.n_name AS other FROM c CROSS JOIN range(4) r(i) JOIN p ON p.place = ({_H.format('c_custkey')} + i) % p.n WHERE p.n_name <> answer),
o AS (SELECT c_custkey, answer, list_sort(list(DISTINCT other))[1:3] AS l FROM e GROUP BY ALL),
z AS (SELECT c_custkey, c_custkey % 4 AS place, l[1:c_custkey % 4] || [answer] || l[c_custkey % 4 + 1:3] AS l FROM o)
SELECT c_custkey AS id, 'A. ' || l[1] || '|B. ' || l[2] || '|C. ' || l[3] || '|D. ' || l[4] AS choices, ['A', 'B', 'C', 'D'][place + 1] AS letter FROM z
""")
def gen_choices(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("number"), F.lit("Nation").alias("answer_type"), F.col("n_name").alias("answer"))
    out = Q.choices(q, nodes(spark, d).where("type = 'Nation'"), mixed("id"))
    return out.withColumn("choices", F.array_join("choices", "|"))


@query("""
WITH q AS (SELECT c.c_custkey, c.c_name AS a, n.n_name AS b FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey),
k AS (SELECT * FROM q CROSS JOIN (VALUES ('forward', 'TF_TRUE'), ('forward', 'TF_FALSE'), ('forward', 'MCQ'), ('backward', 'TF_TRUE'), ('backward', 'TF_FALSE'), ('backward', 'MCQ')) v(direction, kind)),
x AS (SELECT c_custkey, direction, kind, CASE direction WHEN 'forward' THEN a ELSE b END AS s, CASE direction WHEN 'forward' THEN b ELSE a END AS o, CASE direction WHEN 'forward' THEN 'sinh tại' ELSE 'là nơi sinh của' END AS p FROM k)
SELECT 'LOCATED_IN:c' || c_custkey AS edge_id, direction, kind, CASE kind WHEN 'MCQ' THEN s || ' ' || p || '?' ELSE s || ' ' || p || ' ' || o || '. Đúng hay sai?' END AS question, CASE kind WHEN 'TF_TRUE' THEN 'Đúng' WHEN 'TF_FALSE' THEN 'Sai' ELSE o END AS answer FROM x
""")
def gen_six_questions(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d, ("LOCATED_IN",))
    e = G.named(g).where("src_type = 'Customer'").select("edge_id", "src_name", F.lit("BORN_AT").alias("type"), "dst_name")
    return Q.six_questions(e)


@query("""
SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' đã từng giữ chức vụ Order#' || o_orderkey || ', và Order#' || o_orderkey || ' được trao tặng ' || s_name || '. Đúng hay sai?' AS question, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' giữ chức vụ gì, và người/thực thể đó nhận giải thưởng gì?' AS choice
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
""")
def gen_two_hop_texts(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d, ("PLACED", "SUPPLIED_BY"))
    p = paths.chain(g.nodes.where("type = 'Customer'").select("id"), g.edges, ["PLACED", "SUPPLIED_BY"]).select("path")
    n = g.nodes.select("id", "name")
    name = lambda i, c: (n.select(F.col("id").alias(f"i{i}"), F.col("name").alias(c)), F.col("path")[i] == F.col(f"i{i}"))
    for i, c in ((0, "a"), (2, "b"), (4, "c")):
        p = p.join(*name(i, c))
    names, types = F.array("a", "b", "c"), F.array(F.lit("SERVED_AS"), F.lit("AWARDED"))
    return p.select(Q.multi_hop_text(names, types, False).alias("question"), Q.multi_hop_text(names, types, True).alias("choice"))


@query("""
SELECT slot, o_orderstatus AS status, count(*) AS n FROM (SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1) % 4 AS slot FROM orders) GROUP BY ALL
""")
def gen_balanced(spark: SparkSession, d: str) -> DataFrame:
    q = Q.balanced(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderkey")], 4)
    return q.groupBy("slot", F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_QUESTION_ROWS = "q AS (SELECT o_orderkey AS id, 1 + o_orderkey % 4 AS hop_count, CASE o_orderkey % 7 WHEN 0 THEN 'PARAPHRASE' WHEN 1 THEN 'UNANSWERABLE' ELSE 'Normal' END AS variant_type, " + _H.format("o_orderkey") + " AS h FROM orders)"


def _question_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    variant = F.when(k % 7 == 0, "PARAPHRASE").when(k % 7 == 1, "UNANSWERABLE").otherwise("Normal")
    return read(spark, d, "orders").select(k.alias("id"), (1 + k % 4).cast("int").alias("hop_count"), variant.alias("variant_type"), mixed("o_orderkey").alias("h"))


@query(f"""
WITH {_QUESTION_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY variant_type ORDER BY h, id) AS n FROM q WHERE hop_count = 2),
s AS (SELECT * FROM r WHERE (variant_type = 'PARAPHRASE' AND n <= 100) OR (variant_type = 'UNANSWERABLE' AND n <= 100))
SELECT id, hop_count, variant_type FROM s UNION ALL SELECT id, hop_count, variant_type FROM r WHERE variant_type = 'Normal' AND n <= 450 - (SELECT count(*) FROM s)
""")
def gen_filled_sample(spark: SparkSession, d: str) -> DataFrame:
    return Q.filled(_question_rows(spark, d), 2, {"PARAPHRASE": 100, "UNANSWERABLE": 100}, 450, [F.col("h"), F.col("id")]).select("id", "hop_count", "variant_type")


@query(f"""
WITH {_QUESTION_ROWS} SELECT id, hop_count, variant_type FROM (SELECT *, row_number() OVER (PARTITION BY hop_count, variant_type ORDER BY h, id) AS n FROM q) WHERE (hop_count = 1 AND variant_type = 'Normal' AND n <= 50) OR (hop_count = 3 AND variant_type = 'PARAPHRASE' AND n <= 51)
""")
def gen_stratified(spark: SparkSession, d: str) -> DataFrame:
    targets = {(1, "Normal"): 50, (3, "PARAPHRASE"): 51}
    return Q.stratified(_question_rows(spark, d), targets, ["hop_count", "variant_type"], [F.col("h"), F.col("id")]).select("id", "hop_count", "variant_type")


@query(f"""
WITH {_QUESTION_ROWS} SELECT row_number() OVER (ORDER BY hop_count, h, id) AS number, id FROM q
""")
def ord_renumbered(spark: SparkSession, d: str) -> DataFrame:
    return Q.renumbered(_question_rows(spark, d), ["hop_count", "h", "id"], column="number").select("number", "id")


@query(f"""
WITH {_QUESTION_ROWS} SELECT id, hop_count FROM q WHERE hop_count <= 2 UNION ALL SELECT (SELECT max(id) FROM q WHERE hop_count <= 2) + row_number() OVER (ORDER BY h, id), hop_count FROM q WHERE hop_count = 3
""")
def gen_supplemented(spark: SparkSession, d: str) -> DataFrame:
    q = _question_rows(spark, d)
    base = q.where("hop_count <= 2").withColumn("key", F.col("id"))
    return Q.appended(base, q.where("hop_count = 3").withColumn("key", F.col("id")), ["h", "key"]).select("id", "hop_count")


@query("""
SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2
""")
def set_reuse_cap(spark: SparkSession, d: str) -> DataFrame:
    return Q.reuse_cap(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], 2, [F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""
SELECT o_custkey AS id, o_orderkey AS last, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1
""")
def set_last_wins(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("x")
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(last).select("id", F.col("x.o_orderkey").alias("last"), F.col("x.o_orderstatus").alias("status"))


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'only', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
UNION ALL SELECT 'any', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    a, b = o.where("o_orderstatus = 'P'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    n = lambda t, part: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "only")).unionByName(n(a.union(b).distinct(), "any"))


@query("""
SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 40
""")
def ord_page(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").orderBy("s_suppkey").offset(40).limit(20).select("s_suppkey", "s_name")


@query("""
SELECT hop, min(o_orderkey) AS example, count(*) AS n FROM (SELECT o_orderkey, 1 + o_orderkey % 3 AS hop, o_orderpriority FROM orders) GROUP BY hop, o_orderpriority QUALIFY row_number() OVER (PARTITION BY hop ORDER BY min(o_orderkey)) <= 5
""")
def ord_first_examples(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = read(spark, d, "orders").groupBy((1 + F.col("o_orderkey") % 3).alias("hop"), "o_orderpriority").agg(F.min("o_orderkey").alias("example"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("hop").orderBy("example"))).where("r <= 5").select("hop", "example", "n")


@query(f"""
SELECT o_orderkey AS id, CASE WHEN {_H.format('o_orderkey')} % 100 < 30 THEN CASE o_orderstatus WHEN 'O' THEN 'Sai' WHEN 'F' THEN 'Đúng' ELSE 'x' END ELSE CASE o_orderstatus WHEN 'O' THEN 'Đúng' WHEN 'F' THEN 'Sai' ELSE 'x' END END AS answer, {_H.format('o_orderkey')} % 100 < 30 AS negative FROM orders
""")
def gen_negated(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("o_orderstatus") == "O", "Đúng").when(F.col("o_orderstatus") == "F", "Sai").otherwise("x")
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), a.alias("answer"))
    return Q.negated(rows, 30, mixed("id"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'UNANSWERABLE' ELSE 'PARAPHRASE_HARD' END AS variant_type, 'Câu hỏi mới ' || o_orderkey AS question, CASE o_orderkey % 3 WHEN 0 THEN 'Không có dữ kiện' ELSE 'A' END AS answer FROM orders WHERE o_orderkey % 3 <> 1
""")
def gen_variants(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    seeds = read(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("Câu hỏi "), k.cast("string")).alias("question"), F.lit("A").alias("answer"), F.lit("Normal").alias("variant_type"))
    replies = read(spark, d, "orders").select(k.alias("id"), F.when(k % 3 == 0, "UNANSWERABLE").otherwise("PARAPHRASE_HARD").alias("variant_type"), F.when(k % 3 == 1, F.concat(F.lit("câu hỏi "), k.cast("string"))).otherwise(F.concat(F.lit("Câu hỏi mới "), k.cast("string"))).alias("question"))
    return Q.variants(seeds, replies).select("id", "variant_type", "question", "answer")


@query("""
SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'
""")
def src_remaining(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources.readers import remaining

    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return remaining(o, o.where("o_orderstatus = 'F'")).select("id")


@query("""
WITH p AS (SELECT 'cus' || c_custkey AS id, c_name AS name, 'nat' || c_nationkey AS dst FROM customer)
SELECT 1 AS ord, 'MERGE (n:Politician {id: "' || id || '", name: "' || name || '"});' AS line FROM p
UNION ALL SELECT 2, 'MATCH (a:Politician {id: "' || id || '"}), (b:Location {id: "' || dst || '"}) MERGE (a)-[:BORN_AT]->(b);' FROM p
UNION ALL SELECT 2, 'MATCH (a:Politician {id: "cus' || o_custkey || '"}), (b:Position {id: "ord' || o_orderkey || '"}) MERGE (a)-[:SERVED_AS {status: "' || o_orderstatus || '", term_start: "' || strftime(o_orderdate, '%Y-%m-%d') || '"}]->(b);' FROM orders
""")
def snk_import_script(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources.writers import import_script

    none = F.expr("cast(map() as map<string,string>)")
    n = nodes(spark, d).where("type = 'Customer'").select("id", F.lit("Politician").alias("type"), "name", none.alias("properties"))
    e = edges(spark, d, ("LOCATED_IN", "PLACED")).where("src like 'cus%'").withColumn("type", F.when(F.col("type") == "PLACED", "SERVED_AS").otherwise("BORN_AT"))
    return import_script(G.PropertyGraph(n, e), constraints=False).select("ord", "line")


@query("""
SELECT 'nodes' AS part, 'Politician' AS type, '{"id":"cus' || c_custkey || '","type":"Politician","name":"' || c_name || '","properties":{"segment":"' || c_mktsegment || '"}}' AS json FROM customer
UNION ALL SELECT 'edges', 'SERVED_AS', '{"from":"cus' || o_custkey || '","to":"ord' || o_orderkey || '","type":"SERVED_AS","properties":{"term_start":"' || strftime(o_orderdate, '%Y-%m-%d') || '","status":"' || o_orderstatus || '"}}' FROM orders
""")
def snk_export_lines(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources.writers import exported, graph_lines

    c = read(spark, d, "customer")
    props = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("source"), F.lit("x"), F.lit("enriched"), F.lit("true"))
    n = c.select(key("cus", "c_custkey").alias("id"), F.lit("Politician").alias("type"), F.col("c_name").alias("name"), props.alias("properties"))
    e = edges(spark, d, ("PLACED",)).withColumn("type", F.lit("SERVED_AS")).withColumn("properties", F.map_concat("properties", F.create_map(F.lit("source"), F.lit("x"))))
    return graph_lines(exported(G.PropertyGraph(n, e)))


@query("""
SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, value FROM events) GROUP BY ALL
""")
def str_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.ingest import windowed_counts

    w = windowed_counts(read(spark, d, "events"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Not Given' WHEN p_size % 3 = 1 THEN substr('ABCD', CAST(p_partkey % 4 + 1 AS INTEGER), 1) ELSE 'D' END AS answer,
       CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN array_to_string(list_transform(['A. ' || p_name, 'B. ' || p_type, 'C. ' || p_brand, 'D. none'], lambda c, i: CASE WHEN i = p_partkey % 4 + 1 THEN substr(c, 1, 1) || ') Không có dữ kiện' ELSE c END), '|') ELSE 'A. ' || p_name || '|B. ' || p_type END AS choices
FROM part
""")
def gen_no_data(spark: SparkSession, d: str) -> DataFrame:
    """Questions about parts that the data doesn't answer: true-false, four choices, and two."""
    kind = F.col("p_size") % 3
    four = F.array(F.concat(F.lit("A. "), "p_name"), F.concat(F.lit("B. "), "p_type"), F.concat(F.lit("C. "), "p_brand"), F.lit("D. none"))
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(kind == 0, "TRUE_FALSE").otherwise("MCQ").alias("q_type"), F.when(kind == 1, four).when(kind == 2, F.slice(four, 1, 2)).alias("choices"), F.lit("A").alias("answer"))
    return Q.unanswerable(rows, F.col("id")).select("id", "answer", F.coalesce(F.array_join("choices", "|"), F.lit("")).alias("choices"))


@query("""
SELECT 'c' || c_custkey AS id, 1 AS hop, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d'), 'Order#' || o_orderkey) AS INTEGER) AS place, c_name AS source, 'Order#' || o_orderkey AS target FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY place <= 20
UNION ALL SELECT 'n' || q.n_nationkey, 1, CAST(row_number() OVER (PARTITION BY q.n_nationkey ORDER BY c_name, n.n_name) AS INTEGER) AS place, c_name, n.n_name FROM nation q JOIN nation n ON contains(lower(n.n_name), lower(q.n_name)) JOIN customer ON c_nationkey = n.n_nationkey QUALIFY place <= 20
""")
def wf_answered(spark: SparkSession, d: str) -> DataFrame:
    """A question for each customer (what did they order?) and each nation (who lives there?), answered together."""
    from tessera.operators.answering import Answers

    placed = patterns.Pattern("PLACED", "Order", ("term_start", "status"), ("term_start",), (50, 20, 50), source="Customer", as_target="position")
    lives = patterns.Pattern("LOCATED_IN", "Nation", limits=(5, 5, 20), source="Customer", as_target="birth_place")
    entity = lambda text, kind: F.array(F.struct(F.col(text).alias("text"), F.lit(kind).alias("type"))).alias("entities")
    ask = lambda t, prefix, k, text, kind, intent: read(spark, d, t).select(key(prefix, k).alias("id"), F.lit("?").alias("question"), entity(text, kind), F.lit(intent).alias("intent"), F.lit("aggregation").alias("pattern"))
    asked = ask("customer", "c", "c_custkey", "c_name", "Customer", "PLACED").unionByName(ask("nation", "n", "n_nationkey", "n_name", "Nation", "LOCATED_IN"))
    found = Answers(graph(spark, d, ("PLACED", "LOCATED_IN")), "Customer", relations={"PLACED": placed, "LOCATED_IN": lives}).answered(asked)
    return found.select("id", "hop", "place", F.col("names")[0].alias("source"), F.col("names")[1].alias("target"))


@query("""
SELECT id, text, type FROM (SELECT c_custkey AS id, n_name AS text, 'Nation' AS type, 'Is ' || n_name || ' where ' || c_name || ' lives?' AS q FROM customer JOIN nation ON n_nationkey = c_nationkey) x
UNION ALL SELECT c_custkey, c_name, 'Customer' FROM customer
""")
def wf_entities(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.workflow import dictionary_entities

    q = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.concat(F.lit("Is ("), "n_name", F.lit(") where "), "c_name", F.lit(" lives?")).alias("question"))
    found = dictionary_entities(q, nodes(spark, d).where("type in ('Nation', 'Customer')"))
    longest = found.groupBy("id", "type").agg(F.max_by("text", F.length("text")).alias("text"))
    return longest.select("id", "text", "type")


_TIMES = """
WITH q AS (SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey % 4 + 1 AS len, o_orderkey % 3 AS kind FROM orders),
o AS (SELECT q.*, r.o, ((id * 100 + r.o + 50) * 2654435761) % 4294967296 AS pick FROM q CROSS JOIN range(-20, 21) r(o) WHERE r.o <> 0 AND (kind = 0 OR abs(r.o) <= 10)),
said AS (SELECT id, kind, pick, CASE kind WHEN 0 THEN '' || (y + o) WHEN 1 THEN 'từ ' || (y + o) || ' đến ' || (y + len + o) ELSE 'từ ' || (y + o) END AS other FROM o),
w AS (SELECT id, list(other ORDER BY pick)[1:3] AS l FROM said GROUP BY id),
z AS (SELECT w.id, l[1:w.id % 4] || [CASE kind WHEN 0 THEN '' || y WHEN 1 THEN 'từ ' || y || ' đến ' || (y + len) ELSE 'từ ' || y || ' đến nay' END] || l[w.id % 4 + 1:3] AS l FROM w JOIN q ON q.id = w.id)
SELECT id, 'A. ' || l[1] || '|B. ' || l[2] || '|C. ' || l[3] || '|D. ' || l[4] AS choices, ['A', 'B', 'C', 'D'][id % 4 + 1] AS letter FROM z
"""


@query(_TIMES)
def gen_time_choices(spark: SparkSession, d: str) -> DataFrame:
    """When each order was placed: a year, a duration with two years, or one that lasts."""
    kind, y = F.col("o_orderkey") % 3, F.year("o_orderdate")
    said = F.when(kind == 0, y.cast("string")).otherwise(F.concat(F.lit("từ "), y.cast("string"), F.lit(" đến "), F.when(kind == 1, (y + F.col("o_custkey") % 4 + 1).cast("string")).otherwise("nay")))
    q = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("number"), F.when(kind == 0, "Year").otherwise("Duration").alias("answer_type"), said.alias("answer"))
    return Q.time_choices(q, lambda o: mixed(F.col("id") * 100 + o + 50)).withColumn("choices", F.array_join("choices", "|"))


@query(f"""
WITH {O}, s AS (SELECT o.*, c_name FROM o JOIN customer ON c_custkey = o_custkey)
SELECT 'SUCCEEDED:' || o_orderkey AS id, 'Order#' || o_orderkey || ' kế nhiệm ai' || CASE WHEN o_orderkey % 2 = 0 THEN ' (trong chức vụ ' || c_name || ')' ELSE ' ở ' || c_name END || '?' AS question FROM s WHERE b IS NOT NULL
UNION ALL SELECT 'PRECEDED:' || o_orderkey, 'Order#' || o_orderkey || ' là tiền nhiệm của ai' || CASE WHEN o_orderkey % 2 = 0 THEN ' (trong chức vụ ' || c_name || ')' ELSE ' ở ' || c_name END || '?' FROM s WHERE a IS NOT NULL
UNION ALL SELECT '2:' || s.o_orderkey, 'Order#' || s.o_orderkey || ' kế nhiệm ai, và người/thực thể đó kế nhiệm ai?' FROM s JOIN o t ON t.o_orderkey = s.b WHERE t.b IS NOT NULL
""")
def gen_in_context(spark: SparkSession, d: str) -> DataFrame:
    """Questions about who followed whom; odd orders' name the office already, and two steps have two offices."""
    n = nodes(spark, d).select("id", "name")
    e = edges(spark, d, ("SUCCEEDED", "PRECEDED")).select("src", "dst", "type", F.col("properties")["position_id"].alias("office"), "edge_id")
    named = e.join(n.withColumnRenamed("id", "src"), "src").join(n.select(F.col("id").alias("office"), F.col("name").alias("said")), "office")
    tail = F.when(F.substring("src", 4, 20).cast("bigint") % 2 == 0, "?").otherwise(F.concat(F.lit(" ở "), "said", F.lit("?")))
    text = F.replace(Q.multi_hop_text(F.array("name"), F.array("type"), True), F.lit("?"), tail)
    one = named.select(F.col("edge_id").alias("id"), text.alias("question"), F.array("type").alias("types"), F.array("office").alias("offices"))
    s = e.where("type = 'SUCCEEDED'")
    two = s.join(s.select(F.col("src").alias("dst"), F.col("type").alias("type2"), F.col("office").alias("office2")), "dst").join(n.withColumnRenamed("id", "src"), "src")
    types = F.array("type", "type2")
    two = two.select(F.concat(F.lit("2:"), F.substring("src", 4, 20)).alias("id"), Q.multi_hop_text(F.array("name"), types, True).alias("question"), types.alias("types"), F.array("office", "office2").alias("offices"))
    return Q.in_context(one.unionByName(two), n).select("id", "question")


@query("""
WITH q AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'TRUE_FALSE' ELSE 'MCQ' END AS q_type, 1 + p_size % 4 AS hop_count, CASE WHEN p_size % 3 > 0 THEN substr('ABCD', CAST(p_partkey % 4 + 1 AS INTEGER), 1) WHEN p_retailprice > 1000 THEN 'Đúng' ELSE 'Sai' END AS answer FROM part),
s AS (SELECT 'q_type' AS section, q_type AS label FROM q UNION ALL SELECT 'hop_count', '' || hop_count FROM q UNION ALL SELECT CASE q_type WHEN 'MCQ' THEN 'letter' ELSE 'truth' END, answer FROM q)
SELECT section, label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY section), 6) AS percent FROM s GROUP BY section, label
""")
def agg_question_statistics(spark: SparkSession, d: str) -> DataFrame:
    truth = F.col("p_size") % 3 == 0
    letter = F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    q = read(spark, d, "part").select(F.when(truth, "TRUE_FALSE").otherwise("MCQ").alias("q_type"), (1 + F.col("p_size") % 4).alias("hop_count"), F.when(~truth, letter).when(F.col("p_retailprice") > 1000, "Đúng").otherwise("Sai").alias("answer"))
    return Q.statistics(q).withColumn("percent", F.round("percent", 6))
