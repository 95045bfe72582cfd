"""What larger tables showed: how often whole graphs are shuffled or written."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import access, algorithms, distances, graph as G, names, profiles, rewiring


def test_turns_inside_groups(spark, monkeypatch):
    """each turn of swaps shuffled and wrote all samples, some 17 times for three swaps an edge."""
    rng = random.Random(4)
    links = sorted({tuple(sorted(rng.sample([f"n{i:03}" for i in range(200)], 2))) for _ in range(600)} | {("hub", f"n{i:03}") for i in range(150)})
    pairs, written = spark.createDataFrame(links, "a string, b string"), []
    monkeypatch.setattr(rewiring, "INSIDE", 100)
    before = rewiring.cut
    monkeypatch.setattr(rewiring, "cut", lambda df, **kw: written.append(1) or before(df, **kw))
    by = {}
    for r in rewiring.rewired(pairs, 2).collect():
        by.setdefault(r["sample"], []).append((r.a, r.b))
    degree = Counter(x for p in links for x in p)
    for e in by.values():
        assert len(set(e)) == len(links) and all(a < b for a, b in e) and Counter(x for p in e for x in p) == degree
        assert len(set(e) & set(links)) < len(links) / 2
    assert set(by[0]) != set(by[1]) and len(written) <= 10


def test_components_that_come_together(spark, monkeypatch):
    """chains whose edges come together needed the rounds of stars over all edges; now only what lies in two tasks or batches does."""
    rng = random.Random(7)
    chains = [[f"{c:02}x{i}" for i in rng.sample(range(90), 12)] for c in range(30)]
    e = [(a, b) for c in chains for a, b in zip(c, c[1:])]
    want = {x: min(c) for c in chains for x in c} | {"alone": "alone"}
    nodes = spark.createDataFrame([(x,) for x in want], "id string")
    calls = []
    before = algorithms.together
    monkeypatch.setattr(algorithms, "together", lambda edges: calls.append(edges.count()) or before(edges))
    run = lambda rows, parts: {r.id: r.component for r in algorithms.components(nodes, spark.createDataFrame(rows, "src string, dst string").repartition(parts, F.substring("src", 1, 2))).collect()}
    assert run(e + [("alone", "alone")], 3) == want and calls == []
    parts = spark.createDataFrame(rng.sample(e, len(e)), "src string, dst string").repartition(7)
    assert {r.id: r.component for r in algorithms.components(nodes, parts).collect()} == want and len(calls) == 1
    ones = spark.createDataFrame([(int(x[:2]) * 100 + int(x[3:]), int(y[:2]) * 100 + int(y[3:])) for x, y in e], "src long, dst long")
    got = algorithms.components(ones.select(F.col("src").alias("id")), ones).collect()
    assert all(r.component == min(int(x[:2]) * 100 + int(x[3:]) for x in chains[r.id // 100]) for r in got)


def test_both_ways_is_one_node(spark, monkeypatch):
    """a chain with edges both ways took a round over all nodes for each step; what it leads to and comes from goes before."""
    chain = [f"o{i:02}" for i in random.Random(3).sample(range(40), 30)]
    e = [(a, b) for a, b in zip(chain, chain[1:])] + [(b, a) for a, b in zip(chain, chain[1:])]
    e += [("c", x) for x in chain] + [(x, f"s{i % 3}") for i, x in enumerate(chain)] + [(f"s{i}", "n") for i in range(3)] + [("n", "r")]
    nodes = spark.createDataFrame([(x,) for x in {y for p in e for y in p}], "id string")
    turns, before = [], distances._first_before
    monkeypatch.setattr(distances, "_first_before", lambda rest, turn: turns.append(turn) or before(rest, turn))
    run = lambda more: {r.id: r.component for r in distances.strong_components(nodes, spark.createDataFrame(e + more, "src string, dst string")).collect()}
    assert run([]) == {r.id: min(chain) if r.id in chain else r.id for r in nodes.collect()} and turns == []
    assert run([("n", "c")]) == {r.id: "r" if r.id == "r" else "c" for r in nodes.collect()} and turns  # one long way round


def test_tasks_have_parts_of_bounded_size(spark, monkeypatch):
    """a task sorted and grouped a fixed share of all rows; now as many rows as ROWS says, about."""
    monkeypatch.setattr(G, "ROWS", 10)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    e = [(f"o{i % 20}", f"{'ps'[i % 2]}{i % 7}", "SUP" if i % 2 else "CON") for i in range(90)]
    edges = spark.createDataFrame(e, "src string, dst string, type string")
    nodes = spark.createDataFrame([(f"o{i}", "Order", f"O{i}") for i in range(20)] + [(f"{k}{i}", t, f"{t}{i // 2}") for k, t in (("p", "Part"), ("s", "Sup")) for i in range(7)], "id string, type string, name string")
    g, starts = G.PropertyGraph(nodes, edges), nodes.where("type = 'Order' and id <> 'o3'").select("id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = access.neighbours(g, starts, ["SUP", "CON"], ["Sup"])
    assert "hashpartitioning(src" in plan(got) and plan(got).count(", 9), REPARTITION_BY_NUM") == 2
    assert sorted((r.start, r.type, r.id) for r in got.collect()) == sorted({(a, t, b) for a, b, t in e if b[0] == "s" and a != "o3"})
    members = starts.select(F.substring("id", 2, 1).alias("community"), "id")
    out = profiles.connected(members, edges, nodes, 2)
    assert plan(out).count(", 9), REPARTITION_BY_NUM") >= 2
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    name = lambda x: f"{'Part' if x[0] == 'p' else 'Sup'}{int(x[1]) // 2}"
    count = Counter((a[1], name(b)) for a, b in {(a, name(b)): (a, b) for a, b, _ in e if a != "o3"}.values())
    got = out.collect()
    assert got and all(r["count"] == count[r.community, r["name"]] for r in got)
    assert all(r.total == len([1 for c, n in count if c == r.community and n.startswith(r.type)]) for r in got)


def test_runs_of_words_come_in_parts(spark, monkeypatch):
    """all runs of words of a table came in as many parts as small tables have."""
    monkeypatch.setattr(G, "ROWS", 10)
    asked = spark.createDataFrame([(i, f"who is Red Fox {i}, or fox") for i in range(20)], "id int, question string")
    named = spark.createDataFrame([("red fox", "Two"), ("Fox", "One"), ("fox 7", "Two")], "name string, type string")
    out = names.standing(asked, named)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.name) for r in out.collect()) == sorted([(i, x) for i in range(20) for x in ("red fox", "Fox")] + [(7, "fox 7")])
