"""Answering a table of questions against answering one after another, and exhaustive paths against plain enumeration."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import answering, candidates, workflow
from tessera.operators import graph as G

EDGE = "src string, dst string, type string, properties map<string,string>, edge_id string"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(1)
    people = [(f"pol{i:02}", "Politician", f"Nguyễn {c}{'ab'[i % 2]}{i % 7}") for i, c in enumerate("An Bình Chi Dũng Giang Hà Khoa Lan Minh Nam".split())]
    places = [(f"loc{i}", "Location", n) for i, n in enumerate(["Huế", "Hà Nội", "Vinh"])]
    posts = [(f"pos{i}", "Position", n) for i, n in enumerate(["Chủ tịch", "Bộ trưởng", "Thứ trưởng"])]
    rows = []
    for i, (p, _, _) in enumerate(people):
        rows.append((p, rng.choice(places)[0], "BORN_AT", {}))
        for q in rng.sample(posts, rng.randint(0, 2)):
            rows.append((p, q[0], "SERVED_AS", {"term_start": str(1980 + i), "status": ""}))
        if i:
            rows.append((p, people[i - 1][0], "SUCCEEDED", {"position_id": posts[i % 3][0]}))
    nodes = spark.createDataFrame([*people, *places, *posts, ("x", "Location", None)], "id string, type string, name string")
    return G.PropertyGraph(nodes, spark.createDataFrame([(*r, f"e{i:03}") for i, r in enumerate(rows)], EDGE)), people


def shown(kind, row):
    """What a row of one question's step says, as the table has it."""
    d = row.asDict()
    if "node_names" in d:
        return tuple(d["relations"]), tuple(d["node_names"])
    if "path" in d:
        return (len(d["path"]) // 2,)
    if "targets" in d:
        return (d["name"], str(d["n"]))
    if "id" in d and "type" in d:
        return ((), (d["name"],))
    return tuple(v for v in list(d.values())[:2])


def test_questions_together(spark, world):
    graph, people = world
    names = [n for _, _, n in people]
    e = lambda *x: [{"text": t, "type": k} for t, k in x]
    P = "Politician"
    asked = [
        (1, "q", e((names[2], P)), "SUCCEEDED", "chain"), (2, "q", e(("Huế", "Location")), "BORN_AT", "simple"), (3, "q", e((names[0], P), (names[1], P)), None, "path"),
        (4, "q", e((names[0], P), (names[3], P)), "SERVED_AS", "comparison"), (5, "q", e((names[4], P)), None, "explore"), (6, "q", [], "BORN_AT", "simple"), (7, "q", e((names[5], P), ("chủ", "Position")), "SERVED_AS", "aggregation"),
        (8, "q", e((names[6], P), ("Bộ trưởng", "Position")), "SUCCEEDED", "chain"), (9, "q", e(("nobody", P)), "BORN_AT", "simple"), (10, "q", e(("nguyễn", P)), "SUCCEEDED", "simple"), (11, "q", e((names[7], P)), "LIKES", "chain"), (12, "q", None, None, "explore"),
        (13, "q", e((names[8], P)), "PRECEDED", "chain"), (14, "q", e((names[0], P)), "SERVED_AS", "path"),
    ]
    frame = spark.createDataFrame(asked, "id int, question string, entities array<struct<text:string,type:string>>, intent string, pattern string")
    got = {}
    for r in answering.Answers(graph).answered(frame).orderBy("id", "hop", "place").collect():
        got.setdefault((r.id, r.hop), (r.kind, []))[1].append(r)
    for i, q, entities, intent, pattern in asked:
        steps = workflow.Answering(graph).run(q, entities or [], intent, pattern)
        for hop, kind, rows in steps:
            mine = got.pop((i, hop), (kind, []))
            assert mine[0] == kind and len(mine[1]) == len(rows), (i, hop, kind, mine, rows)
            for a, b in zip(mine[1], rows, strict=True):
                said = shown(kind, b)
                if len(said) == 1:
                    assert len(a.relations) == said[0]
                elif "targets" in b:
                    assert (a.names[0], a.properties["n"]) == said
                elif isinstance(said[0], tuple):
                    assert (tuple(a.relations), tuple(a.names)) == said, (i, hop)
                else:
                    assert tuple(a.names) == said, (i, hop)
    assert not got
    assert answering.Answers(graph).answered(frame.limit(0)).count() == 0


def test_enough_ends_a_question(spark, world):
    graph, people = world
    frame = spark.createDataFrame([(1, "stop", [(people[4][2], "Politician")], "SUCCEEDED", "simple"), (2, "go on", [(people[4][2], "Politician")], "SUCCEEDED", "simple")], "id int, question string, entities array<struct<text:string,type:string>>, intent string, pattern string")
    rows = answering.Answers(graph, enough=lambda question, seen: (question == "stop") & (F.size(seen) > 0)).answered(frame)
    hops = {r.id: r.n for r in rows.groupBy("id").agg(F.max("hop").alias("n")).collect()}
    assert hops[1] == 1 and hops[2] > 1


def test_exhaustive(spark):
    rng = random.Random(2)
    ids = [f"n{i}" for i in range(12)]
    e = [(a, b, t, {}, f"{k:03}") for k, (a, b, t) in enumerate((rng.choice(ids), rng.choice(ids), rng.choice("ST")) for _ in range(60))]
    nodes = spark.createDataFrame([(x, "N", None if x == "n3" else f"name {x}") for x in ids], "id string, type string, name string")
    graph = G.PropertyGraph(nodes, spark.createDataFrame(e, EDGE))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()

    def paths(hops, out):
        kept = {}
        for a, b, t, _, _ in sorted(e, key=lambda r: r[4]):
            kept.setdefault(a, []).append((t, b))
        near = {a: sorted({(t, b) for t, b in x[: out or len(x)] if b != a and "n3" not in (a, b)}) for a, x in kept.items()}
        found = [[a] for a in near]
        for _ in range(hops):
            found = [[*p, t, b] for p in found for t, b in near.get(p[-1], []) if b not in p[::2]]
        return found

    for hops in (2, 3, 4):
        for out, most in ((None, None), (3, None), (None, 20), (3, 7), (None, 10**6)):
            expected = paths(hops, out)
            if most is not None:
                expected = sorted(expected, key=lambda p: (md5("42|" + "|".join(p[:5])), md5("42|" + "|".join(p))))[:most]
            got = [r.path for r in candidates.exhaustive(graph, hops, out, most).collect()]
            assert sorted(got) == sorted(expected)
    starts = nodes.where("id in ('n1', 'n2')")
    assert sorted(r.path for r in candidates.exhaustive(graph, 3, starts=starts).collect()) == sorted(p for p in paths(3, None) if p[0] in ("n1", "n2"))
