"""Names in texts and names like each other, against all pairs; and how many rows the joins make where names begin alike."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.answers import similarity_match
from tessera.operators import names, patterns, vectors


def people(n: int, seed: int = 1) -> list[str]:
    """Names of two to four words, a third of which begin with the same one."""
    rng = random.Random(seed)
    syllables = ["An", "Bình", "Chi", "Dũng", "Đức", "Giang", "Hà", "Hải", "Hùng", "Khánh", "Lan", "Minh", "Nam", "Phúc", "Quang", "Sơn", "Thảo", "Trung", "Tuấn", "Vân"]
    first = lambda: "Nguyễn" if rng.random() < 0.4 else rng.choice(["Trần", "Lê", "Phạm"])
    return [" ".join([first(), *rng.choices(syllables, k=rng.randint(1, 3))]) for _ in range(n)]


def test_standing(spark):
    rng, known = random.Random(2), people(300)
    known = [*known, "", None, "  ", "Nguyễn", "A-B c", "của"]
    asked = [(i, f"Ông {rng.choice(known[:300]).upper() if i % 3 else rng.choice(known[:300])} là con của {rng.choice(known[:300])}{rng.choice(['?', 'x', ', và'])} a-b C") for i in range(200)] + [(900, None), (901, ""), (902, "a b c"), (903, "nguyễn")]
    q = spark.createDataFrame(asked, "id int, question string")
    got = names.standing(q, spark.createDataFrame([(x, "P") for x in known], "name string, type string"))
    words = lambda t: [w for w in re.split(r"[^\w#]+", (t or "").lower()) if w]
    run = lambda t, w: any(t[i : i + len(w)] == w for i in range(len(t)))
    expected = {(i, n) for i, t in asked for n in set(known) if words(n) and run(words(t), words(n)) and n.lower() in (t or "").lower()}
    assert sorted((r.id, r.name) for r in got.collect()) == sorted(expected) and len(expected) > 400
    assert names.standing(q, spark.createDataFrame([], "name string, type string")).count() == 0


def test_standing_joins_few_rows(spark):
    """Two thousand names that begin alike and 500 questions: what is joined is what is found, not a million rows."""
    known = [f"Nguyễn Văn {chr(65 + i % 26)}{i}" for i in range(2000)]
    q = spark.createDataFrame([(i, f"Nguyễn Văn {chr(65 + i % 26)}{i} sinh ở đâu?") for i in range(500)], "id int, question string")
    frame = names.standing(q, spark.createDataFrame([(x, "P") for x in known], "name string, type string"))
    assert frame.count() == 500
    rows = frame._jdf.queryExecution().executedPlan().toString()
    frame.collect()
    joined = []

    def walk(p):
        if "Join" in p.nodeName():
            joined.append(p.metrics().apply("numOutputRows").value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    plan = frame._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan)
    assert rows and all(n <= 1000 for n in joined)


def test_contained(spark):
    rng = random.Random(3)
    texts = [*people(200), "", None, "aa", "b", "aXa"]
    parts = ["", "n", "Ng", "NGU", "ễn V", "inh", "zzz", "a", "aa", *[t[rng.randrange(3) : rng.randrange(4, 12)] for t in texts[:60]]]
    got = names.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in parts], "part string")).collect()
    assert sorted((r.text, r.part) for r in got) == sorted({(t, p) for t in texts for p in parts if t is not None and p and p.lower() in t.lower()})
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["Ann", "Joann", "Bob", None, "Ann"])], "id int, name string")
    found = patterns.column_search(frame, "name", spark.createDataFrame([("ann",), ("o",)], "word string")).collect()
    assert sorted((r.id, r.word) for r in found) == [(0, "ann"), (1, "ann"), (1, "o"), (2, "o"), (4, "ann")]


@pytest.mark.parametrize("threshold", [0.9, 0.8, 0.6])
def test_similar(spark, threshold):
    rng = random.Random(4)
    left = [*people(120, 5), " an ", "", "ab", "a", None, "aaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabc"]

    def typo(x):
        i = rng.randrange(len(x))
        return x[:i] + rng.choice(["", "x", x[i] * 2]) + x[i + 1 :]

    right = [*[typo(x) for x in left[:80]], *[typo(typo(x)).upper() for x in left[:40]], *people(40, 6), "AN", "", None, "aaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcab", "b"]
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = [(r.left, r.right) for r in names.similar(frame(left), frame(right), threshold).collect()]
    low = lambda x: x.lower().strip()
    expected = {(a, b) for a in left for b in right if None not in (a, b) and (low(a) == low(b) or (low(a) and low(b) and similarity_match(a, b, threshold)))}
    assert sorted(got) == sorted(expected) and len(expected) > 80


def test_index(spark, tmp_path):
    """Every row is in one cell, all cells together are the exact search, and the cells of a query alone have 0.9 of it; with ties, zeros and a crowd of equal vectors."""
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)]) for i in range(900)] + [(2000 + i, centres[0]) for i in range(400)] + [(5000, [0.0] * 12), (5001, None)]
    e = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    index = vectors.build_index(e, f"{tmp_path}/index")
    assert index.rows.count() == 1301 and index.rows.select("id").distinct().count() == 1301
    q = e.where("id % 50 = 0 and vector is not null")
    exact = vectors.top_k(e, q, 10)
    whole = vectors.search_index(index, q, 10, len(index.centres))
    key = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert key(whole) == key(exact)
    assert index.probes < len(index.centres) and vectors.recall_of(vectors.search_index(index, q, 10), exact) >= 0.9
    none = vectors.build_index(e.limit(0), f"{tmp_path}/none")
    assert vectors.search_index(none, q, 10).count() == 0 and vectors.search_index(index, q.limit(0), 10).count() == 0


def test_best_of_batches(spark):
    """The k best over many batches, with ties by id, as a sort of all has them."""
    rng = random.Random(8)
    v = [[rng.randint(-2, 2) * 1.0 for _ in range(4)] for _ in range(700)]
    e = spark.createDataFrame(list(enumerate(v)), "id long, vector array<double>").coalesce(1)
    got = {(r.query_id, r["rank"]): r.id for r in vectors.top_k(e, e.where("id % 100 = 0"), 7).collect()}
    norm = lambda x: sum(y * y for y in x) ** 0.5
    for i in range(0, 700, 100):
        score = [round(sum(a * b for a, b in zip(v[i], x, strict=True)) / max(norm(v[i]) * norm(x), 1e-300), 12) for x in v]
        assert [got[i, k] for k in range(1, 8)] == sorted(range(700), key=lambda j: (-score[j], j))[:7]


def test_pairs_of_names_have_no_cross_join(spark):
    a = spark.createDataFrame([(x,) for x in people(50)], "name string")
    plan = names.similar(a, a.where(F.col("name") > "L"), 0.9)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
