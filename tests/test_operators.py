"""Hand-made graphs, records and questions."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import algorithms as A
from tessera.operators import communities, distances, evaluation, paths, patterns, questions, records, workflow
from tessera.operators import graph as G
from tessera.sources import readers, writers

EDGE = "src string, dst string, type string, properties map<string,string>, ord bigint"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, p, i) for i, (a, b, t, p) in enumerate(rows)], EDGE)


@pytest.fixture
def people(spark):
    nodes = spark.createDataFrame([("pol1", "Politician", "Ann"), ("pol2", "Politician", "Bob"), ("pos1", "Position", "Mayor"), ("loc1", "Location", "Hue"), ("loc2", "Location", "Da Nang")], "id string, type string, name string")
    e = edges(spark, ("pol1", "pos1", "SERVED_AS", {"term_start": "1990"}), ("pol2", "pos1", "SERVED_AS", {}), ("pol1", "loc1", "BORN_AT", {}), ("pol2", "loc1", "BORN_AT", {}), ("pol2", "pol1", "SUCCEEDED", {"position_id": "pos1"}))
    return G.PropertyGraph(nodes, e)


def test_merges(spark):
    e = edges(spark, ("a", "b", "T", {"s": "1", "e": "9"}), ("a", "b", "T", {"s": "2"}))
    assert G.merge_overwrite(e).head().properties == {"s": "2", "e": "9"}
    assert G.merge_last(e).head().properties == {"s": "2"}
    assert G.merge_with_properties(e).count() == 2


def test_interning(spark):
    m = spark.createDataFrame([("P", "Mayor", "7", 1), ("P", " mayor ", "8", 2), ("P", "Chief", "7", 3), ("R", "Major", "7", 4), ("P", "", "9", 5)], "label string, name string, source_id string, ord int")
    got = {(r.id, r.name) for r in G.intern(m, F.when(F.col("label") == "R", "mil").otherwise("mil")).collect()}
    assert got == {("mil7_001", "Mayor"), ("mil7_002", "Chief"), ("mil7_003", "Major")}


def test_patterns(people):
    got = patterns.from_intent(people, "SERVED_AS", [{"type": "Politician", "text": "an"}]).collect()
    assert [tuple(r) for r in got] == [("Ann", "Mayor", "1990", None, None, None)]
    assert patterns.from_intent(people, "SERVED_AS", []) is None and patterns.from_intent(people, "X", []) is None
    both = patterns.from_intent(people, "SERVED_AS", [{"type": "Position", "text": "MAYOR"}]).collect()
    assert [r.name for r in both] == ["Ann", "Bob"]  # nulls last
    assert [tuple(r) for r in patterns.from_intent(people, "SUCCEEDED", [{"type": "Politician", "text": "Ann"}, {"type": "Position", "text": "may"}]).collect()] == [("Ann", "Bob")]
    assert patterns.comparison(people, "BORN_AT", ["Ann"]) is None
    assert [tuple(r)[:2] for r in patterns.comparison(people, "BORN_AT", ["Ann", "Bob"]).collect()] == [("Ann", 1), ("Bob", 1)]
    seen = {(r.source_entity, tuple(r.relations), tuple(r.node_names)) for r in patterns.exploration(people, ["Ann"]).collect()}
    assert ("Ann", ("BORN_AT",), ("Ann", "Hue")) in seen and ("Ann", ("BORN_AT", "BORN_AT"), ("Ann", "Hue", "Bob")) in seen and ("Ann", ("BORN_AT", "BORN_AT"), ("Ann", "Hue", "Ann")) not in seen


def test_paths(spark, people):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    near = paths.shortest(ids("pol2"), ids("loc1", "loc2"), people.edges, 4).collect()
    assert [(r.end, r.length, r.path) for r in near] == [("loc1", 1, ["pol2", "BORN_AT", "loc1"])]
    two = paths.simple_paths(ids("pol2"), ids("loc1"), people.edges, 2, 4).collect()
    assert [r.path for r in two] == [["pol2", "SUCCEEDED", "pol1", "BORN_AT", "loc1"]]
    p = spark.createDataFrame([(1, ["pol1", "BORN_AT", "loc1"]), (2, ["pol1", "BORN_AT"]), (3, ["pol1", "DIED_AT", "loc1"]), (4, ["pol1"]), (5, ["pol1", "BORN_AT", "x"])], "id int, path array<string>")
    assert {r.id for r in paths.verify(p, people.nodes, people.edges).where("valid").collect()} == {1}
    assert paths.answers(p.where("id = 1"), people.nodes).head().answer == "Hue"
    assert paths.k_hop(people.edges, 2).count() == 2 and len(paths.sample(people.nodes, 2, 1).collect()) == 2


def test_analytics(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1)], "a string, b string, weight int")
    n = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    e = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    c = {r.id: r.clustering for r in A.clustering(n, pairs.select("a", "b")).collect()}
    assert c == {"a": 1.0, "b": 1.0, "c": pytest.approx(1 / 3), "d": 0.0, "e": 0.0}
    assert {r.id: r.component for r in A.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e"}
    ranks = {r.id: r.rank for r in A.pagerank(n, e).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and ranks["d"] > ranks["b"] > ranks["a"] == ranks["e"]
    h = {r.id: (r.hub, r.authority) for r in A.hits(n, e).collect()}
    assert sum(x for x, _ in h.values()) == pytest.approx(1) and sum(y for _, y in h.values()) == pytest.approx(1)
    b = {r.id: r.betweenness for r in distances.betweenness(n, e).collect()}
    assert b["c"] == pytest.approx(2 / 12) and b["a"] == 0
    both = e.union(e.select("dst", "src"))
    close = {r.id: r.closeness for r in distances.closeness(n.where("id <> 'e'"), both).collect()}
    assert close["c"] == pytest.approx(1.0) and close["d"] == pytest.approx(3 / 5)
    part = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0)], "id string, community int")
    prof = A.community_profile(pairs.select("a", "b"), part).head()
    assert (prof.density, prof.top_id, prof.top_centrality) == (pytest.approx(2 / 3), "c", 1.0)
    length = distances.path_lengths(n, e).head()
    assert (length.nodes, length.mean_length, length.longest) == (4, pytest.approx(8 / 6), 2)
    cliques = [(f"{g}{i}", f"{g}{j}", 1) for g in "xy" for i in range(4) for j in range(i)] + [("x0", "y0", 1)]
    w = spark.createDataFrame([(min(a, b), max(a, b), v) for a, b, v in cliques], "a string, b string, weight int")
    ids = w.select(F.col("a").alias("id")).union(w.select("b")).distinct()
    found = {r.id: r.community for r in communities.louvain(ids, w).collect()}
    assert len({v for k, v in found.items() if k[0] == "x"}) == 1 and found["x1"] != found["y1"]


def test_metrics(spark):
    rows = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B")], "y_true string, y_pred string")
    m = evaluation.metrics(rows).head()
    assert (m.accuracy, m.precision, m.recall, m.f1_score) == tuple(pytest.approx(100 * x) for x in (2 / 3, 5 / 6, 2 / 3, 2 / 3))
    odd = spark.createDataFrame([("A", None), ("A", "C")], "y_true string, y_pred string")
    assert {r.label: (r.precision, r.support) for r in evaluation.per_class(odd).collect()} == {"A": (0.0, 2), "C": (0.0, 0)}


def test_records(spark):
    rows = spark.createDataFrame([("Ann", "1", "infobox", {"tên": "A", "name": "AB", "office": "Chief|term_start=tháng 3, 2010|junk", "battles": "Dien Bien", "branch": "Army", "years_of_service": "1960-1970"}), (None, "2", "x", {"a": "b"}), ("C", "3", "x", {"a": "{{b}}"})], "title string, id string, template string, infobox map<string,string>")
    first = {"tên": "A", "name": "AB", "office": "Chief|term_start=tháng 3, 2010|junk", "battles": "Dien Bien", "branch": "Army", "years_of_service": "1960-1970"}
    ordered = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])  # the order of fields matters
    rows = rows.withColumn("infobox", F.when(F.col("id") == "1", ordered).otherwise(F.col("infobox")))
    done = records.cleaned(records.normalized_keys(rows)).collect()
    assert [r.title for r in done] == ["Ann"]
    assert done[0].infobox == {"name": "A; AB", "office": "Chief", "term_start": "2010-03", "battles": "Dien Bien", "branch": "Army", "years_of_service": "1960-1970"}
    m = records.mentions(records.with_lists(records.cleaned(records.normalized_keys(rows))))
    got = {(r.edge, r.name): r.properties for r in m.collect()}
    assert got[("SERVED_AS", "Chief")] == {"term_start": "2010-03"} and got[("FOUGHT_IN", "Dien Bien")] == {} and got[("SERVED_IN", "Army")] == {"year_start": "1960", "year_end": "1970"}
    assert records.persons(records.with_lists(rows.where("title is not null"))).where("id = 'pol1'").head().properties["party"] == "Đảng Cộng sản Việt Nam"
    s = records.with_summaries(rows.where("id = '1'"), spark.createDataFrame([("Ann", "'''Ann''' is x.\n== y ==")], "title string, text string")).head()
    assert s.summary == "Ann is x."


def test_questions(spark):
    assert questions.quotas(100) == {1: 20, 2: 40, 3: 24, 4: 16}
    assert questions.quotas(100, available={1: 20, 2: 10, 3: 99, 4: 99}) == {1: 20, 2: 10, 3: 54, 4: 16}
    rows = spark.createDataFrame([(i, 2, "PARAPHRASE" if i < 120 else "UNANSWERABLE" if i < 210 else "Normal") for i in range(610)], "id int, hop_count int, variant_type string")
    got = questions.filled(rows, 2, {"PARAPHRASE": 100, "UNANSWERABLE": 100}, 450, [F.col("id")])
    assert {r.variant_type: r["count"] for r in got.groupBy("variant_type").count().collect()} == {"PARAPHRASE": 100, "UNANSWERABLE": 90, "Normal": 260}
    b = questions.balanced(rows, ["hop_count"], [F.col("id")], 4).groupBy("slot").count().collect()
    assert max(r["count"] for r in b) - min(r["count"] for r in b) <= 1
    assert [r.n for r in questions.renumbered(rows.withColumnRenamed("id", "x"), ["x"], 5, "n").orderBy("x").limit(3).collect()] == [5, 6, 7]


def test_workflow(spark, people):
    q = spark.createDataFrame([("ai là người kế nhiệm x", 1, "SUCCEEDED"), ("abc", 0, None)], "q string, n int, i string")
    best = workflow.best_pattern(workflow.pattern_scores(F.col("q"), F.col("n"), F.col("i")))
    got = q.select(best["pattern"], best["score"]).collect()
    assert [tuple(r) for r in got] == [("chain", pytest.approx(0.6)), ("explore", pytest.approx(0.5))]
    steps = workflow.Answering(people).run("?", [{"type": "Politician", "text": "Bob"}], "SUCCEEDED", "chain")
    assert [(h, k) for h, k, _ in steps][0] == (1, "intent")
    found = workflow.dictionary_entities(spark.createDataFrame([(1, "Was Ann born in Da Nang?")], "id int, question string"), people.nodes).collect()
    assert {r.text for r in found} == {"Ann", "Da Nang"}


def test_files(spark, people, tmp_path):
    (tmp_path / "g.json").write_text('{"metadata": {"total_nodes": 1}, "nodes": {"Politician": [{"id": "pol1", "type": "Politician", "name": "A", "properties": {"party": "x"}}]}, "edges": {"BORN_AT": [{"from": "pol1", "to": "loc1", "type": "BORN_AT"}]}}')
    g = readers.graph_document(spark, str(tmp_path / "g.json"))
    assert g.nodes.head().properties == {"party": "x"} and g.edges.head().dst == "loc1"
    (tmp_path / "bad.json").write_text('{"k": [1, 2,], }')
    assert readers.tolerant_json(spark, str(tmp_path / "bad.json"), "k array<int>").head().doc.k == [1, 2]
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>A</title><id>1</id><revision><id>9</id><text bytes='3'>{{infobox|name=x}}</text></revision></page></mediawiki>")
    assert readers.infobox_records(spark, str(tmp_path / "dump.xml")).head().infobox == {"name": "x"}
    writers.graph_tables(people, str(tmp_path / "t"))
    writers.replace_edges(edges(spark, ("pol1", "pol2", "SUCCEEDED", {})), str(tmp_path / "t"))
    t = readers.graph_tables(spark, str(tmp_path / "t"))
    assert t.edges.where("type = 'SUCCEEDED'").head().src == "pol1" and t.edges.count() == 5
    lines = [r.line for r in writers.import_script(people.__class__(people.nodes.withColumn("properties", F.expr("cast(map() as map<string,string>)")), people.edges)).orderBy("ord", "at", "line").collect()]
    assert lines[9] == 'MERGE (n:Politician {id: "pol1", name: "Ann"});'
    assert 'MATCH (a:Politician {id: "pol2"}), (b:Politician {id: "pol1"}) MERGE (a)-[:SUCCEEDED {position_id: "pos1"}]->(b);' in lines
    q = spark.createDataFrame([("TF", "a\nb", 1, "[]", "Normal", "True")], "q_type string, question string, hop_count int, reasoning_path string, variant_type string, answer string")
    writers.questions(q, str(tmp_path / "q"))
    pair = readers.csv_pair(spark, str(tmp_path / "q/questions/q_type=TF"), str(tmp_path / "q/answers/q_type=TF")).head()
    assert (pair.question, pair.answer) == ("a\nb", "Đúng")
    (tmp_path / "n.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.value for r in readers.names(spark, str(tmp_path / "n.txt")).collect()) == ["a", "b"]
    assert "total_nodes: 5" in writers.report({"graph": writers.metadata(people)})


def test_stream(spark, tmp_path):
    from tessera.streaming.ingest import current, merge_edges

    for i, rows in enumerate([[("a", "b", "T", {"v": "1"})], [("a", "b", "T", {"v": "2"}), ("c", "d", "T", {})]]):
        edges(spark, *rows).write.mode("append").json(str(tmp_path / "in"))
        merge_edges(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        got = {(r.src, r.dst): r.properties for r in current(spark, str(tmp_path / "t")).collect()}
        assert len(got) == i + 1 and got["a", "b"] == {"v": "1"}


def test_centralities_see_the_whole_graph(spark):
    """The registered queries leave out no kind of node."""
    from tests.conftest import DATA
    from tessera.plans import graph_queries, tables  # noqa: F401

    kinds = lambda name, column: {r.id[:3]: r[column] for r in tables.QUERIES[name](spark, DATA).orderBy(column).collect()}
    between = kinds("alg_betweenness", "betweenness")
    assert set(between) == {"cus", "sup", "par", "nat", "reg", "ord"} and between["ord"] > 0  # nothing leads to a customer
    assert set(kinds("alg_closeness", "closeness")) == {"par", "sup", "nat"}
