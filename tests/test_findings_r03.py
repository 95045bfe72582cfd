"""What the third round's reviewer found. Triangles, provinces and exhaustive paths are held to their results; the others also to what is written, searched or joined."""

from __future__ import annotations

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import text
from tessera.operators import algorithms, candidates, distances, graph as G, names, paths, rewiring
from tessera.plans.tables import mixed
from tests import brute_graphs as brute


def written(monkeypatch, *modules) -> list[int]:
    """The rows of each table that these modules write from now on."""
    rows = []

    plain = G.cut

    def counted(df, instead_of=None):
        out = plain(df, instead_of)
        rows.append(out.count())
        return out

    for m in modules:
        monkeypatch.setattr(m, "cut", counted)
    return rows


def test_hash_of_large_numbers(spark):
    """F16: the product passed 64 bits."""
    ns = [0, 1, 65_535, 65_536, 3_474_701_543, 4_294_967_296, 9_000_000_000_999, 2**62 + 12_345]
    got = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", mixed("n").alias("h")).collect()
    assert {r.n: r.h for r in got} == {n: n * 2654435761 % 2**32 for n in ns}


def test_triangles_of_layers(spark):
    """where many nodes lead to few that lead on, the counts stay right."""
    low, high = [f"p{i:02}" for i in range(50)], [f"s{i:02}" for i in range(20)]
    e = {(p, s) for p in low for s in high} | {("n", s) for s in high} | {("n", p) for p in low[:10]}
    pairs = spark.createDataFrame([(min(p), max(p)) for p in e], "a string, b string")
    got = {r.id: r.triangles for r in algorithms.triangles(pairs).collect()}
    near = brute.neighbours([*e, *[(b, a) for a, b in e]])
    assert got == {x: sum(b in near[a] for a, b in combinations(near[x], 2)) for x in near}


def test_triangles_of_random_graphs(spark):
    rng = random.Random(7)
    e = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(260)} | {(0, i) for i in range(1, 40)}
    e = [(f"v{a:02}", f"v{b:02}") for a, b in e]
    got = {r.id: r.triangles for r in algorithms.triangles(spark.createDataFrame(e, "a string, b string")).collect()}
    near = brute.neighbours([*e, *[(b, a) for a, b in e]])
    assert got == {x: sum(b in near[a] for a, b in combinations(near[x], 2)) for x in near}


@pytest.mark.parametrize("chosen", [False, True])
def test_totals_of_twins(spark, monkeypatch, chosen):
    """300 nodes in 6 classes of equal neighbours took 5 blocks of 64; directed ways back, tails and lone nodes beside."""
    calls, plain = [], distances.reached
    monkeypatch.setattr(distances, "reached", lambda *a: calls.append(1) or plain(*a))
    hubs = [f"h{i}" for i in range(4)]
    e = [(hubs[i], hubs[(i + 1) % 4]) for i in range(4)]
    for i in range(300):
        x = f"c{i:03}"
        e += [(x, hubs[i % 4])] if i % 3 else [(x, hubs[0]), (hubs[2], x)]
        e += [(hubs[1], x)] * (i % 3 == 2)
    ids = [*hubs, *[f"c{i:03}" for i in range(300)], "lone1", "lone2"]
    e += [("c000", "tail"), ("tail", "end")]
    ids += ["tail", "end"]
    sources = [x for i, x in enumerate(ids) if not chosen or i % 3 == 0]
    nodes, edges = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(e, "src string, dst string")
    got = {r.id: (r.sources, r.total, r.longest) for r in distances.totals(nodes, edges, spark.createDataFrame([(x,) for x in sources], "id string") if chosen else None, words=1).collect()}
    near = brute.neighbours(e)
    d = {s: brute.distances(near, s) for s in sources}
    assert got == {v: ((x := [d[s][v] for s in sources if s != v and v in d[s]]) and (len(x), sum(x), max(x))) or (0, 0, 0) for v in ids}
    assert len(calls) == 1


def test_betweenness_takes_more_at_once(spark, monkeypatch):
    """blocks of a fixed size were as many as the graph has nodes."""
    calls, plain = [], distances._dependencies
    monkeypatch.setattr(distances, "_dependencies", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(distances, "AT_ONCE", 5)
    rng = random.Random(3)
    ids = [f"n{i:02}" for i in range(60)]
    e = [tuple(rng.sample(ids, 2)) for _ in range(120)]
    nodes, edges = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(e, "src string, dst string")
    got = {r.id: r.betweenness for r in distances.betweenness(nodes, edges).collect()}
    assert got == pytest.approx(brute.betweenness(ids, e)) and len(calls) <= 3


def hub_graph(spark):
    """200 nodes to one hub, each with two of its own; the hub leads on to another."""
    e = [(f"c{i:03}", "hub", "IN") for i in range(200)] + [(f"c{i:03}", f"o{i:03}{k}", "HAS") for i in range(200) for k in "ab"] + [(f"o{i:03}a", f"s{i % 5}", "BY") for i in range(200)] + [(f"s{i}", "goal", "IN") for i in range(5)] + [("hub", "top", "IN")]
    return spark.createDataFrame([(a, b, t, f"{a}:{b}") for a, b, t in e], "src string, dst string, type string, edge_id string")


def test_between_opens_no_hub(spark, monkeypatch):
    """at the hub all 200 nodes were followed for each pair, as its side had one node."""
    rows = written(monkeypatch, paths)
    pairs = spark.createDataFrame([(f"c{i:03}", "hub" if i % 2 else "goal") for i in range(0, 200)] + [("o000b", "hub")], "start string, end string")
    got = {(r.start, r.end): (r.length, list(r.path)) for r in paths.between(pairs, hub_graph(spark), 3).collect()}
    assert got == {(f"c{i:03}", "hub" if i % 2 else "goal"): (1, [f"c{i:03}", "IN", "hub"]) if i % 2 else (3, [f"c{i:03}", "HAS", f"o{i:03}a", "BY", f"s{i % 5}", "IN", "goal"]) for i in range(200)}
    rows.clear()
    more = spark.createDataFrame([(f"d{i:03}", f"o{i:03}{k}", "HAS", f"d{i:03}{k}") for i in range(200) for k in "ab"], "src string, dst string, type string, edge_id string")
    none = spark.createDataFrame([(f"d{i:03}", "hub") for i in range(200)], "start string, end string")
    assert paths.between(none, hub_graph(spark).unionByName(more), 3).count() == 0 and max(rows) <= 3000


def test_shortest_keeps_what_can_arrive(spark, monkeypatch):
    """the last level had all 200 neighbours of the hub for each of its 200 starts."""
    rows = written(monkeypatch, paths)
    starts, ends = spark.createDataFrame([(f"c{i:03}",) for i in range(200)], "id string"), spark.createDataFrame([("hub",), ("top",)], "id string")
    got = {(r.start, r.end): (r.length, list(r.path)) for r in paths.shortest(starts, ends, hub_graph(spark), 2, directed=False).collect()}
    assert got == {(f"c{i:03}", x): (1, [f"c{i:03}", "IN", "hub"]) if x == "hub" else (2, [f"c{i:03}", "IN", "hub", "IN", "top"]) for i in range(200) for x in ("hub", "top")}
    assert max(rows) <= 2000


def test_described_searches_no_paths(spark, monkeypatch):
    """path lengths were searched for a query that has none."""
    calls = []
    monkeypatch.setattr(rewiring, "path_lengths", lambda *a: calls.append(1))
    nodes, edges = spark.createDataFrame([(x,) for x in "abcd"], "id string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c")], "src string, dst string")
    r = rewiring.described(nodes, edges).head()
    assert (r.nodes, r.edges, r.mean_degree) == (4, 4, 2.0) and r.clustering == pytest.approx((1 + 1 + 1 / 3) / 4) and not calls


def test_exhaustive_writes_few_halves(spark, monkeypatch):
    """the kept paths are the first of all, whatever halves are written (the old code passes this too)."""
    rng = random.Random(5)
    ids = [f"n{i:02}" for i in range(50)]
    e = sorted({(a, rng.choice("XY"), b) for a in ids for b in rng.sample(ids, 9) if a != b})
    nodes = spark.createDataFrame([(x, x, "T") for x in ids], "id string, name string, type string")
    edges = spark.createDataFrame([(a, b, t, f"{a}{t}{b}") for a, t, b in e], "src string, dst string, type string, edge_id string")
    mark = lambda path: hashlib.md5("|".join(["42", *path]).encode()).hexdigest()
    near = {}
    for a, t, b in e:
        near.setdefault(a, []).append((t, b))
    for hops in (3, 4):
        every = [[a] for a in ids]
        for _ in range(hops):
            every = [[*p, t, b] for p in every for t, b in near[p[-1]] if b not in p[::2]]
        expected = sorted(every, key=lambda p: (mark(p[:5]), mark(p)))[:20]
        with monkeypatch.context() as m:
            rows = written(m, G)
            got = [r.path for r in candidates.exhaustive(G.PropertyGraph(nodes, edges), hops, None, 20).collect()]
        assert got == expected and max(rows[1:]) < len(every) / 2 and rows[0] == len(e)
    got = {tuple(r.path) for r in candidates.exhaustive(G.PropertyGraph(nodes, edges), 3, None, 10**6, spark.createDataFrame([("n07",)], "id string")).collect()}
    assert got == {(*("n07",), t, b, u, c, v, d) for t, b in near["n07"] for u, c in near[b] if c != "n07" for v, d in near[c] if d not in ("n07", b)}


def test_province_reads_a_place_once(spark):
    """the place was stripped anew for each of the names, whose patterns were made anew for each row."""
    places = spark.createDataFrame([(i, f"{C.PROVINCES[i % len(C.PROVINCES)][0]}, phường {i} cũ") for i in range(2000)] + [(-1, None), (-2, ""), (-3, "nowhere")], "i int, x string")
    plan = places.select(text.province(F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("x#") <= 4
    got = {r.i: r.p for r in places.select("i", text.province(F.col("x")).alias("p")).collect()}
    assert (got[-1], got[-2], got[-3]) == ("", "", "") and all(got[i] for i in range(2000))


def test_numbered_names_meet_at_long_runs(spark, monkeypatch):
    """runs of three characters are shared by a fixed share of all numbered names, so pairs to look at grew with their square."""
    tables, plain = [], G.cut
    monkeypatch.setattr(names, "cut", lambda df: tables.append(plain(df)) or tables[-1])
    every = [f"Customer#{i:09}" for i in range(1500)]
    texts = spark.createDataFrame([(x,) for x in [*every, "two: Customer#000000007 and NATION_12", "nation_1", "x"]], "text string")
    parts = spark.createDataFrame([(x,) for x in [*every, "NATION_1", "X", "or", ""]], "part string")
    got = {(r.text, r.part) for r in names.contained(texts, parts).collect()}
    assert got == {(x, x) for x in every} | {("two: Customer#000000007 and NATION_12", p) for p in (every[7], "NATION_1")} | {("nation_1", "NATION_1"), ("x", "X")}
    asked, held, rarest = tables
    assert rarest.join(held, "gram").count() <= 2 * len(every)
