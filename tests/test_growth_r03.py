"""What the third round's reviewer expects of larger tables: how often a query reads, writes or follows a row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import algorithms, build, candidates, communities, graph as G, paths, questions, records as R


def test_records_are_made_once(spark):
    """persons, mentions and offices come from one run of what makes the records."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    box = F.expr("map('office', concat('Office ', id % 3), 'predecessor', concat('[[P', id - 1, '|before]]'), 'successor', concat('P', id + 1, ', P', id + 2), 'birth_place', 'Town')")
    rows = spark.range(40).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("title"), "id", F.lit("officeholder").alias("template"), box.alias("infobox"))
    g = build.build(R.with_lists(rows.mapInArrow(counted, rows.schema)))
    n = {r.type: r.n for r in g.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"SERVED_AS": 40, "BORN_AT": 40, "SUCCEEDED": 39, "PRECEDED": 39 + 38}
    assert g.nodes.count() == 40 + 3 + 1
    assert made.value == 40


def test_only_movers_links_are_followed(spark):
    """F8: a round of Louvain reads the links of the nodes whose turn it is, and the others stay where they are."""
    read = spark.sparkContext.accumulator(0)

    def weighed(w):
        read.add(1)
        return w

    pairs = [(a, b) for a in range(8) for b in range(8) if a != b and a // 4 == b // 4]
    near = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "id long, near long, weight double").withColumn("weight", F.udf(weighed, "double")("weight"))
    member = spark.createDataFrame([(i, i, 3.0) for i in range(8)], "id long, community long, k double")
    got = {r.id: r.community for r in communities._round(near, member, 24.0, 1.0, F.col("id") % 4 > 1).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 5, 6: 4, 7: 4}
    assert read.value == sum(a % 4 > 1 for a, _ in pairs)


def test_paths_without_brackets_are_not_parsed_as_json(spark):
    """each text went through the JSON parser, which failed on it."""
    said = ["a -> X -> b", "a|X|b", '["a", "X", "b"]', ' [ "a","X" , "b" ]', "a[1] -> X -> b", "", None, '"a"', "[a|X"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").select("i", text.path_array(F.col("x")).alias("p"))
    assert [r.p for r in df.orderBy("i").collect()] == [*[["a", "X", "b"]] * 4, ["a[1]", "X", "b"], [""], None, ['"a"'], ["[a", "X"]]
    assert "CASE WHEN Contains(x#" in df._jdf.queryExecution().analyzed().toString().split("from_json(")[0]


def test_dead_ends_join_their_last_edges_once(spark):
    """the last edges were joined for each length of chains."""
    followed = spark.createDataFrame([(f"o{i}", f"o{i + 1}", "SUCCEEDED", "p") for i in range(6)], "src string, dst string, type string, position_id string")
    served = spark.createDataFrame([(f"o{i}", "p") for i in range(7)], "holder string, position string")
    last = spark.createDataFrame([(f"o{i}", f"s{i % 2}", "BY") for i in range(7)] + [("o3", "o2", "BY")], "src string, dst string, type string")
    out = candidates.dead_ends(followed, served, last, 3)
    every = [[f"o{i}", *[y for j in range(1, k + 1) for y in ("SUCCEEDED", f"o{i + j}")], "BY", f"s{(i + k) % 2}"] for k in (1, 2, 3) for i in range(7 - k)]
    assert sorted(r.path for r in out.collect()) == sorted(every)  # o3 leads to o2 only by chains that o2 is on
    assert out._jdf.queryExecution().analyzed().toString().count(" AS last#") == 1


def counted(spark, df):
    """df, and an accumulator of the rows that were made for it."""
    made = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(each, df.schema), made


def test_candidates_are_made_once(spark):
    """the candidates were made anew to sample their ranges."""
    rows, made = counted(spark, spark.range(500).select(F.array(F.lit("a"), F.lit("X"), F.col("id").cast("string")).alias("path"), F.lit(1).alias("hop_count")))
    got = candidates.gathered([rows], 7).collect()
    assert sorted(r.number for r in got) == list(range(1, 501)) and made.value == 500


def test_rounds_shuffle_only_what_edges_bring(spark, monkeypatch):
    """values and edges lie in the same buckets; ends of many edges come by a broadcast, with the same results."""
    rng = random.Random(2)
    ids = [f"n{i:02}" for i in range(40)]
    e = [(a, rng.choice(ids)) for a in ids[:30] for _ in range(3)] + [("n00", x) for x in ids] + [(x, "n01") for x in ids] + [("n02", "n03")] * 3 + [("n04", "elsewhere")]
    nodes, edges = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(e, "src string, dst string")
    near, name, far = algorithms.adjacent(edges.withColumn("w", F.lit(1)), "src", "dst")
    values, at = G.bucketed(nodes.withColumn("v", F.lit(1.0)), ["id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = algorithms._carried(values, near, far, F.col("v") * F.col("w"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert far is None and plan.count("Exchange hashpartitioning") == 1
    G.unbucketed(spark, name, at)
    hub, rank = {x: 1.0 for x in ids}, {x: 1 / 40 for x in ids}
    for _ in range(5):
        authority = {x: sum(hub[a] for a, b in e if b == x) for x in ids}
        authority = {x: v / sum(authority.values()) for x, v in authority.items()}
        hub = {x: sum(authority[b] for a, b in e if a == x and b in authority) for x in ids}
        hub = {x: v / sum(hub.values()) for x, v in hub.items()}
        lost = sum(rank[x] for x in ids if not any(a == x for a, _ in e))
        out = {x: sum(a == x for a, _ in e) for x in ids}
        rank = {x: 0.15 / 40 + 0.85 * (sum(rank[a] / out[a] for a, b in e if b == x) + lost / 40) for x in ids}
    for most in (algorithms.HUB, 7):
        monkeypatch.setattr(algorithms, "HUB", most)
        got = {r.id: (r.hub, r.authority) for r in algorithms.hits(nodes, edges, 5, None).collect()}
        assert {x: v[0] for x, v in got.items()} == pytest.approx(hub) and {x: v[1] for x, v in got.items()} == pytest.approx(authority)
        assert {r.id: r.rank for r in algorithms.pagerank(nodes, edges, iterations=5, tolerance=None).collect()} == pytest.approx(rank)
