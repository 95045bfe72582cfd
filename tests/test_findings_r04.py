"""What the fourth round's reviewer found: results that hold whatever the input's size, and searches that take no round for each block of sources."""

from __future__ import annotations

import random

import pytest

from tessera.operators import distances, paths
from tests import brute_graphs as brute
from tests.test_findings_r03 import written


def frames(spark, ids, e):
    return spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(e, "src string, dst string")


def test_path_lengths_of_many_nodes(spark):
    """with over 5,000 nodes only 1,000 sources were searched; both ends of the chain are among those that count."""
    ids = [f"v{i:04}" for i in range(5100)]
    e = [("hub", x) for x in ids] + [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("w9", "hub")]
    n, k = len(ids), 10
    r = distances.path_lengths(*frames(spark, [*ids, "hub", *[f"w{i}" for i in range(k)]], e)).head()
    total = n * (n - 1) * 2 + 2 * n + 2 * sum(i * (1 + n) + i * 0 + n for i in range(1, k + 1)) + 2 * sum((k - d) * d for d in range(1, k))
    assert (r.nodes, r.shortest, r.longest) == (n + 1 + k, 1, k + 1)
    assert r.mean_length == pytest.approx(total / ((n + 1 + k) * (n + k)))


def sparse(n: int, m: int) -> tuple[list[str], list[tuple[str, str]]]:
    rng = random.Random(11)
    ids = [f"n{i:03}" for i in range(n)]
    return ids, [tuple(rng.sample(ids, 2)) for _ in range(m)] + [(ids[0], x) for x in ids[1:40]]


def test_blocks_of_sources_take_no_rounds(spark, monkeypatch):
    """each block of sources went through its rounds alone, one after the other."""
    calls, plain = [], distances.reached
    monkeypatch.setattr(distances, "reached", lambda *a: calls.append(1) or plain(*a))
    ids, e = sparse(100, 200)
    e += [(x, ids[1]) for x in ids[70:90]]
    same = {r.id: tuple(r) for r in distances.totals(*frames(spark, ids, e), words=1).collect()}
    assert not calls
    d = {s: brute.distances(brute.neighbours(e), s) for s in ids}
    assert {k: v[1:] for k, v in same.items()} == {v: ((x := [d[s][v] for s in ids if s != v and v in d[s]]) and (len(x), sum(x), max(x))) or (0, 0, 0) for v in ids}
    monkeypatch.setattr(distances, "HELD", 0)
    assert {r.id: tuple(r) for r in distances.totals(*frames(spark, ids, e), words=1).collect()} == same and len(calls) > 1


def test_betweenness_takes_no_rounds(spark, monkeypatch):
    """each level of all searches was shuffled. What a task holds is halved until its ways fit, and gives the same."""
    calls, plain = [], distances._dependencies
    monkeypatch.setattr(distances, "_dependencies", lambda *a: calls.append(1) or plain(*a))
    ids, e = sparse(80, 200)
    expected = brute.betweenness(ids, e)
    monkeypatch.setattr(distances, "SOURCES_HELD", 30)
    for held in (4_000_000, 250):
        monkeypatch.setattr(distances, "HELD", held)
        assert {r.id: r.betweenness for r in distances.betweenness(*frames(spark, ids, e)).collect()} == pytest.approx(expected)
    assert not calls


def test_pairs_of_a_start_share_its_search(spark, monkeypatch):
    """F8: what a start leads to was written for each of its pairs, 9,000 rows here."""
    rows = written(monkeypatch, paths)
    e = [(f"s{i}", f"m{i}{j:02}", "A") for i in range(5) for j in range(30)] + [(f"m{i}00", f"t{k:02}", "B") for i in range(5) for k in range(60)]
    e += [(f"x{k:02}{n:02}", f"t{k:02}", "C") for k in range(60) for n in range(40)] + [("s0", "t00", "D"), ("s1", "m000", "A")]
    edges = spark.createDataFrame([(a, b, t, f"{a}:{b}") for a, b, t in e], "src string, dst string, type string, edge_id string")
    pairs = spark.createDataFrame([(f"s{i}", f"t{k:02}") for i in range(5) for k in range(60)] + [("s0", "s1"), ("x0000", "t01")], "start string, end string")
    got = {(r.start, r.end): (r.length, list(r.path)) for r in paths.between(pairs, edges, 3).collect()}
    middle = {i: "m000" if i == 1 else f"m{i}00" for i in range(5)}  # the least
    expected = {(f"s{i}", f"t{k:02}"): (2, [f"s{i}", "A", middle[i], "B", f"t{k:02}"]) for i in range(5) for k in range(60)}
    assert got == expected | {("s0", "t00"): (1, ["s0", "D", "t00"])} and max(rows) <= 3000
