"""Cases of the stages around questions: choices of times, offices in questions, statistics, reports, days, intents, extractions, hubs."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.operators import algorithms, build, evaluation, graph as G, patterns, questions as Q, records, rewiring, workflow
from tessera.sources import readers, writers


def test_time_choices(spark):
    rows = [(1, 0, "Year", "1990"), (2, 1, "Year", "x"), (3, 2, "Duration", "từ 1990 đến 1995"), (4, 3, "Duration", "từ 1990"), (5, 4, "Duration", "?"), (6, 5, "Place", "1990"), (7, 6, "Year", None)]
    q = spark.createDataFrame(rows, "id int, number int, answer_type string, answer string")
    found = {r.id: r for r in Q.time_choices(q, lambda o: F.xxhash64("id", o)).collect()}
    assert set(found) == {1, 3, 4}
    for r in found.values():
        texts = [c[3:] for c in r.choices]
        answer = {x[0]: x[3] for x in rows}[r.id]
        assert [c[:3] for c in r.choices] == ["A. ", "B. ", "C. ", "D. "] and len(set(texts)) == 4 and texts["ABCD".index(r.letter)] == answer
        years = [[int(y) for y in re.findall(r"\d{4}", t)] for t in texts]
        most = Q.YEAR_SPREAD if r.id == 1 else Q.DURATION_SPREAD
        assert all(abs(y[0] - 1990) <= most and len(y) == (2 if r.id == 3 else 1) and y[-1] - y[0] == (5 if r.id == 3 else 0) for y in years)


def test_with_office(spark):
    cases = [("A kế nhiệm ai?", ["X"], "A kế nhiệm ai (trong chức vụ X)?"), ("A kế nhiệm ai?", [], "A kế nhiệm ai?"), ("A sinh ở đâu?", ["X"], "A sinh ở đâu?"), ("A là tiền nhiệm của ai ở X.", ["X"], "A là tiền nhiệm của ai ở X?"), ("A kế nhiệm ai?", ["X", "Y"], "A kế nhiệm ai?"), (None, ["X"], None)]
    t = spark.createDataFrame([(i, q, o) for i, (q, o, _) in enumerate(cases)], "i int, q string, o array<string>")
    assert [r.x for r in t.orderBy("i").select(Q.with_office(F.col("q"), F.col("o")).alias("x")).collect()] == [x for _, _, x in cases]


def test_in_context_keeps_rows(spark):
    """Edges without office, offices without node or name, and other relations' properties leave a question as it is."""
    n = spark.createDataFrame([("p1", "Chair"), ("p2", "")], "id string, name string")
    rows = [(1, ["SUCCEEDED"], ["p1"], "said"), (2, ["SUCCEEDED"], ["p2"], "same"), (3, ["SUCCEEDED"], ["p3"], "same"), (4, ["SUCCEEDED"], [None], "same"), (5, ["SERVED_AS"], ["p1"], "same"), (6, ["SERVED_AS", "PRECEDED"], [None, "p1"], "said")]
    r = spark.createDataFrame([(i, "A kế nhiệm ai?", t, o) for i, t, o, _ in rows], "id int, question string, types array<string>, offices array<string>")
    found = {x.id: x.question for x in Q.in_context(r, n).collect()}
    assert found == {i: "A kế nhiệm ai (trong chức vụ Chair)?" if k == "said" else "A kế nhiệm ai?" for i, _, _, k in rows}


def test_statistics_of_nothing(spark):
    none = spark.createDataFrame([], "q_type string, hop_count int, answer string")
    assert Q.statistics(none).collect() == []
    some = spark.createDataFrame([("MCQ", 1, "A"), ("MCQ", None, None), ("TRUE_FALSE", 2, "Đúng")], "q_type string, hop_count int, answer string")
    assert {(r.section, r.label): r.n for r in Q.statistics(some).collect()} == {("q_type", "MCQ"): 2, ("q_type", "TRUE_FALSE"): 1, ("hop_count", "1"): 1, ("hop_count", "2"): 1, ("letter", "A"): 1, ("truth", "Đúng"): 1}


def test_evaluation_files(spark, tmp_path):
    rows = [("MCQ", 1, "Normal", "A", "A"), ("MCQ", None, None, "B", None), ("MCQ", 2, "Normal", "B", "A"), ("TRUE_FALSE", 1, "Normal", "Đúng", None)]
    r = spark.createDataFrame(rows, "q_type string, hop_count int, variant_type string, y_true string, y_pred string")
    found = {x.q_type: x for x in evaluation.statistics(r).collect()}
    m, t = found["MCQ"], found["TRUE_FALSE"]
    assert (m.total, m.correct, m.incorrect, m.no_response, m.metrics.accuracy) == (3, 1, 1, 1, 50.0) and m.accuracy == pytest.approx(100 / 3)
    assert [tuple(x) for x in m.by_hop] == [("1", 2, 1), ("2", 1, 0)] and [tuple(x) for x in m.by_variant] == [("Normal", 3, 1)]
    assert (t.total, t.correct, t.incorrect, t.no_response, t.accuracy, t.metrics) == (1, 0, 0, 1, 0.0, None)
    writers.evaluation(r, str(tmp_path / "e"))
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "e" / "metrics")).collect())
    assert "MCQ questions" in text and "no response: 1" in text and "accuracy: 50.00%" in text
    assert spark.read.json(str(tmp_path / "e" / "results")).count() == 4 and spark.read.json(str(tmp_path / "e" / "statistics")).count() == 2


def test_small_world_report(spark):
    """Of a ring whose nodes know two on each side."""
    n = 12
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id int")
    edges = spark.createDataFrame([(i, (i + k) % n) for i in range(n) for k in (1, 2)], "src int, dst int")
    seen = rewiring.observed(nodes, edges).head().asDict()
    assert (seen["nodes"], seen["edges"], seen["mean_degree"], seen["largest"], seen["longest"]) == (12, 24, 4.0, 12, 3) and seen["clustering"] == pytest.approx(0.5)
    samples = spark.createDataFrame([(0, 0.2, 2.0), (1, 0.3, 1.5)], "sample int, clustering double, mean_length double")
    text = rewiring.report(seen, rewiring.small_world(samples, seen["clustering"], seen["mean_length"]).head().asDict(), 2)
    assert "largest component: 12 (100.0%)" in text and "2 samples" in text and text.endswith("=> small world") and "p of clustering: 0.0000 (significant)" in text
    flat = rewiring.small_world(samples.withColumn("clustering", F.lit(0.0)), 0.5, 2.0).head().asDict()
    assert rewiring.report(seen, flat, 2).endswith("sigma: none => no small world")


def test_days(spark):
    r = spark.createDataFrame([("{{ngày sinh|1990|2|28}}", None), ("{{ngày sinh|1990|2|30}}", "1/2/1980"), ("", "x")], "born string, died string")
    assert {x.column: tuple(x)[1:] for x in records.day_counts(r, ["born", "died"], 2024).collect()} == {"born": (1, 1, 1), "died": (1, 0, 2)}
    assert [tuple(x) for x in records.with_days(r, ["born", "died"], 2024).collect()] == [("1990-02-28", None), (None, "1980-02-01"), (None, None)]
    assert records.day_counts(r.limit(0), ["born"], 2024).collect() == [] and dates.DATE_KEY


def test_intents(spark):
    routed = spark.createDataFrame([(1, "a"), (2, "out_of_scope"), (3, None), (4, "a"), (5, "b")], "id int, label string")
    gated = spark.createDataFrame([(1, 0.5, True), (2, 0.1, True), (5, 0.95, False)], "query_id int, best double, passes boolean")
    found = {r.id: (r.intent, r.confirmed, r.score, r.reply is not None) for r in workflow.intents(routed, gated).collect()}
    out = ("out_of_scope", None, None, True)
    assert found == {1: ("a", True, 0.5, False), 2: out, 3: out, 4: ("a", False, 1.0, False), 5: ("b", False, 0.95, False)}


def test_extractions_into_the_graph(spark):
    """The first good reply counts, and what it says becomes edges."""
    long = "x" * build.LEAST_SUMMARY
    r = spark.createDataFrame([("p1", long), ("p2", long), ("p3", "short"), ("p4", None), ("p5", long)], "id string, summary string")
    good = '{"awards": [{"name": "Star", "year": "1999"}]}'
    replies = [("p1", 1, None), ("p1", 3, good.replace("Star", "Moon")), ("p1", 2, f"```json\n{good}\n```"), ("p2", 1, "no"), ("p3", 1, good), ("p9", 1, good)]
    found = build.extraction_stage(r, spark.createDataFrame(replies, "record_id string, attempt int, reply string"))
    rows = {x.id: x for x in found.collect()}
    assert {k: (x.status, x.attempts) for k, x in rows.items()} == {"p1": ("extracted", 3), "p2": ("failed", 1), "p3": ("short", 0), "p4": ("short", 0), "p5": ("waiting", 0)}
    assert rows["p1"].answer.awards[0].name == "Star" and rows["p3"].answer is None
    none = "cast(map() as map<string,string>)"
    n = spark.createDataFrame([("p1", "Politician", "A")], "id string, type string, name string").withColumn("properties", F.expr(none))
    e = spark.createDataFrame([], "src string, dst string, type string, properties map<string,string>")
    g, _ = build.enriched(G.PropertyGraph(n, e), found.where("status = 'extracted'").select(F.col("id").alias("person"), "answer"))
    assert [(x.src, x.type) for x in g.edges.collect()] == [("p1", "AWARDED")]


def test_compared(spark):
    n = spark.createDataFrame([("a", "Politician", "An", {"party": "Y"}), ("b", "Politician", "Bo", {}), ("c", "Politician", "An", {"party": "X"}), ("t", "Award", "An Star", {})], "id string, type string, name string, properties map<string,string>")
    e = spark.createDataFrame([("a", "t", "AWARDED"), ("a", "t", "AWARDED"), ("b", "t", "SERVED_AS")], "src string, dst string, type string")
    g = G.PropertyGraph(n, e)
    assert patterns.compared(g, ["an"], "party") is None
    assert [tuple(r) for r in patterns.compared(g, ["an", "BO"], "party").collect()] == [("An", "X"), ("An", "Y"), ("Bo", None)]
    assert [(r.name, r.party, r.total, r["items"]) for r in patterns.compared(g, ["an", "bo"], "party", "AWARDED").collect()] == [("An", "Y", 2, ["An Star", "An Star"]), ("An", "X", 0, []), ("Bo", None, 0, [])]


def test_pagerank_of_hubs(spark, monkeypatch):
    """A node whose edges lie in several buckets has the rank that one bucket gives; no edges and no nodes have theirs."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, 0) for i in range(1, 30)] + [(1, 2), (1, 2), (3, 3)], "src int, dst int")
    nodes = spark.createDataFrame([(i,) for i in range(61)], "id int")
    whole = {r.id: r.rank for r in algorithms.pagerank(nodes, edges).collect()}
    monkeypatch.setattr(algorithms, "HUB", 7)
    split = {r.id: r.rank for r in algorithms.pagerank(nodes, edges).collect()}
    assert split == pytest.approx(whole, abs=1e-12) and sum(split.values()) == pytest.approx(1)
    assert [r.rank for r in algorithms.pagerank(nodes, edges.limit(0)).collect()] == pytest.approx([1 / 61] * 61)
    assert algorithms.pagerank(nodes.limit(0), edges.limit(0)).collect() == []
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessera_buckets")]


def test_records_of_both_forms(spark, tmp_path):
    """A folder of lines and arrays: each file is read by its own form."""
    a, b, c, none = tmp_path / "a b+c.json", tmp_path / "b.json", tmp_path / "c.json", tmp_path / "none"
    one = lambda i: '{"id": "%d", "title": "t%d"}' % (i, i)
    a.write_text("\n" + one(1) + "\n" + one(2) + "\n")
    b.write_text("[\n" + one(3) + ",\n" + one(4) + "\n]")
    c.write_text(f"[{one(5)}]")
    titles = lambda path, **how: sorted(r.title for r in readers.records(spark, str(path), **how).collect() if r.title)
    assert titles(tmp_path) == ["t1", "t2", "t3", "t4", "t5"] and titles(a) == titles(a, lines=True) == ["t1", "t2"] and titles(b) == titles(b, lines=False) == ["t3", "t4"]
    none.mkdir()
    (none / "x.json").write_text("\n")
    assert titles(none) == []
