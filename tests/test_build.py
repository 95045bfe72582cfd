"""Graph build, enrichment, candidates and scale repairs, on small cases worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import algorithms, build, candidates, graph as G, questions as Q, records as R
from tessera.streaming import ingest

NONE = "cast(map() as map<string,string>)"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "An", "t", {"office": "Chủ tịch A", "term_start": "1990", "predecessor": "[[Bình|ông Bình]]", "successor": "Cường, Dung", "birth_place": "Hà Nội"}),
        (2, "Bình", "t", {"office": "chủ tịch  a", "office2": "Bộ trưởng", "successor": "[[An]]", "death_place": "Huế"}),
        (3, "Cường", "t", {"office3": "Bộ trưởng", "predecessor3": "none"}),
        (4, "an", "t", {"birth_place": "Huế"}),
        (5, "", "t", {"office": "Vô danh"}),
    ]
    return R.with_lists(frame(spark, rows, "id long, title string, template string, infobox map<string,string>"))


def test_build(records):
    g = build.build(records)
    nodes = {r.id: (r.type, r.name) for r in g.nodes.collect()}
    assert nodes == {
        "pol1": ("Politician", "An"), "pol2": ("Politician", "Bình"), "pol3": ("Politician", "Cường"),
        "pos1_001": ("Position", "Chủ tịch A"), "pos2_001": ("Position", "Bộ trưởng"), "pos5_001": ("Position", "Vô danh"),
        "loc1_001": ("Location", "Hà Nội"), "loc2_001": ("Location", "Huế"),
    }
    edges = sorted((r.src, r.type, r.dst, r.properties.get("position_id")) for r in g.edges.collect())
    assert edges == sorted([
        ("pol1", "SERVED_AS", "pos1_001", None), ("pol2", "SERVED_AS", "pos1_001", None), ("pol2", "SERVED_AS", "pos2_001", None), ("pol3", "SERVED_AS", "pos2_001", None),
        ("pol1", "BORN_AT", "loc1_001", None), ("pol1", "BORN_AT", "loc2_001", None), ("pol2", "DIED_AT", "loc2_001", None),
        ("pol1", "SUCCEEDED", "pol2", "pos1_001"), ("pol1", "PRECEDED", "pol3", "pos1_001"), ("pol2", "PRECEDED", "pol1", "pos1_001"),
    ])
    only = build.build(records, links_only=True).edges.where("type = 'PRECEDED'").collect()
    assert [(r.src, r.dst) for r in only] == [("pol2", "pol1")]
    empty = build.build(records.limit(0))
    assert empty.nodes.count() == empty.edges.count() == 0


def test_enriched(spark, records):
    g = build.build(records)
    answer = "struct<positions:array<struct<name:string,term_start:string,status:string>>,awards:array<struct<name:string,year:string>>,locations:array<struct<name:string,relation:string>>>"
    rows = [
        ("pol1", ([("CHỦ TỊCH A", "1999", ""), ("Đại sứ", None, "x")], [("Huân chương", "1980"), ("", None)], [("Sài Gòn", "died in")])),
        ("pol2", ([("đại sứ", None, None)], None, None)), ("pol9", ([("Không ai", None, None)], None, None)), ("pol3", None),
    ]
    new, log = build.enriched(g, frame(spark, rows, f"person string, answer {answer}"))
    name = {r.id: r.name for r in new.nodes.collect()}
    added = sorted((r.src, r.type, name[r.dst], tuple(sorted(r.properties.items()))) for r in new.edges.join(g.edges, ["src", "dst", "type"], "left_anti").collect())
    assert added == sorted([("pol1", "SERVED_AS", "Đại sứ", (("status", "x"),)), ("pol2", "SERVED_AS", "Đại sứ", ()), ("pol1", "AWARDED", "Huân chương", (("year", "1980"),)), ("pol1", "DIED_AT", "Sài Gòn", ())])
    assert new.nodes.count() == g.nodes.count() + 3 and new.edges.count() == g.edges.count() + 4
    assert {r.label: (r.mentions, r.nodes, r.edges) for r in build.log_counts(log).collect()} == {"Position": (3, 1, 2), "Award": (1, 1, 1), "Location": (1, 1, 1)}
    kept = build.worth_extracting(frame(spark, [(1, None), (2, "x" * 49), (3, " " * 60), (4, "x" * 50)], "id int, summary string"))
    assert [r.id for r in kept.collect()] == [4]


def test_candidates(spark):
    nodes = frame(spark, [("a", "P", "A"), ("b", "P", "B"), ("c", "P", "C"), ("x", "L", "X"), ("y", "L", "")], "id string, type string, name string").withColumn("properties", F.expr(NONE))
    e = [("a", "b", "SUCCEEDED", "p1"), ("b", "c", "SUCCEEDED", "p1"), ("b", "a", "PRECEDED", "p2"), ("c", "x", "BORN_AT", None), ("c", "x", "BORN_AT", None), ("c", "x", "BORN_AT", None), ("a", "y", "BORN_AT", None), ("a", "a", "AWARDED", None)]
    edges = frame(spark, e, "src string, dst string, type string, position_id string").withColumn("properties", F.map_filter(F.create_map(F.lit("position_id"), F.col("position_id")), lambda _, v: v.isNotNull()))
    g = G.PropertyGraph(nodes, edges)
    assert [r.path for r in candidates.one_hop(g).collect()] == [["c", "BORN_AT", "x"]] * 2
    served = frame(spark, [("a", "p1"), ("b", "p1"), ("c", "p1"), ("a", "p0"), ("b", "p0")], "holder string, position string")
    assert sorted((r.src, r.dst, r.type, r.position_id) for r in candidates.common_positions(edges.where("type <> 'BORN_AT' and type <> 'AWARDED'"), served).collect()) == [("a", "b", "SUCCEEDED", "p0"), ("b", "a", "PRECEDED", "p0"), ("b", "c", "SUCCEEDED", "p1")]
    found = candidates.dead_ends(edges.where("position_id is not null"), served, edges.where("type = 'BORN_AT'"))
    assert sorted((r.hop_count, "|".join(r.path)) for r in found.collect()) == [(2, "b|SUCCEEDED|c|BORN_AT|x"), (3, "a|SUCCEEDED|b|SUCCEEDED|c|BORN_AT|x")]
    pairs = frame(spark, [("a", "x"), ("a", "c"), ("b", "x"), ("a", "b")], "start string, end string")
    assert sorted((r.hop_count, "|".join(r.path)) for r in candidates.shortest_candidates(g, pairs, served).collect()) == [(2, "a|SUCCEEDED|b|SUCCEEDED|c"), (2, "b|SUCCEEDED|c|BORN_AT|x"), (3, "a|SUCCEEDED|b|SUCCEEDED|c|BORN_AT|x")]
    every = candidates.gathered([candidates.one_hop(g), found], 1)
    assert sorted(r.number for r in every.collect()) == [1, 2, 3, 4] and every.where("hop_count = 1").count() == 2
    assert candidates.plan(3000) == {("MCQ", "Normal"): 1000, ("MCQ", "UNANSWERABLE"): 250, ("MCQ", "PARAPHRASE"): 250, ("TRUE_FALSE", "Normal"): 1000, ("TRUE_FALSE", "UNANSWERABLE"): 250, ("TRUE_FALSE", "PARAPHRASE"): 250}


def test_fallbacks_and_distinct_questions(spark):
    pool = frame(spark, [(f"a{i}", "Award", f"Huân chương {i}") for i in range(2)] + [(f"p{i}", "Position", f"Chức {i}") for i in range(5)], "id string, type string, name string")
    assert {(r.type, r.n) for r in Q.with_fallbacks(pool).groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()} >= {("Award", 7), ("Position", 5)}
    rows = frame(spark, [(3, "q"), (1, "q"), (2, "r"), (1, "q")], "id int, question string")
    assert sorted((r.id, r.question) for r in Q.distinct_questions(rows, ["id"]).collect()) == [(1, "q"), (2, "r")]


def test_succession_by_name(spark):
    nodes = frame(spark, [("1", "Nguyễn Văn An"), ("2", "Trần An"), ("3", None), ("4", "Bùi Thị B"), ("5", "O")], "id string, name string")
    edges = frame(spark, [("s", "an", "X"), ("s", "văn AN", "X"), ("s", "o", "X"), ("s", "zz", "X"), ("s", "", "X"), ("s", None, "X"), ("t", "Trần An", "Y")], "src string, dst_name string, type string")
    names = {r.id: r.name for r in nodes.collect() if r.name}
    expected = sorted((r.src, i, r.type) for r in edges.collect() if r.dst_name for i, n in names.items() if r.dst_name.lower() in n.lower())
    assert sorted(map(tuple, G.succession_by_name(edges, nodes).collect())) == expected and len(expected) > 4


def test_eigenvector_by_joins(spark):
    """Communities above the kernel's size give the same, and so do those that never settle."""
    rng = random.Random(3)
    rows = list({(f"n{min(a, b)}", f"n{max(a, b)}"): (f"n{min(a, b)}", f"n{max(a, b)}", float(rng.randint(1, 5))) for a, b in ((rng.randrange(20), rng.randrange(20)) for _ in range(60)) if a != b}.values())
    pairs = frame(spark, rows, "a string, b string, weight double")
    community = frame(spark, [(f"n{i}", i % 2) for i in range(20)], "id string, community int")
    for iterations in (60, 3):
        whole, joined = ({r.id: r.eigenvector for r in algorithms.eigenvector(pairs, community, iterations, 1e-3, k).collect()} for k in (10**6, 5))
        assert joined == pytest.approx(whole, rel=1e-9)


def test_stream_parts(spark, tmp_path):
    """Batches add parts with what is new alone; compaction keeps the table."""
    incoming, table = tmp_path / "in", str(tmp_path / "table")
    incoming.mkdir()
    for n, rows in enumerate([[("a", "b", 1), ("a", "b", 2)], [("a", "b", 3), ("b", "c", 4)], [("c", "d", 5)]]):
        (incoming / f"{n}.json").write_text("\n".join(json.dumps({"src": s, "dst": d, "type": "T", "properties": {"k": str(o)}, "ord": o}) for s, d, o in rows))
        ingest.merge_edges(spark, str(incoming), table, str(tmp_path / "checkpoint")).awaitTermination()
    read = lambda: sorted((r.src, r.dst, r.properties["k"]) for r in ingest.current(spark, table).collect())
    assert read() == [("a", "b", "1"), ("b", "c", "4"), ("c", "d", "5")] and len(ingest._parts(spark, table)) == 3
    ingest.compact(spark, table)
    assert read() == [("a", "b", "1"), ("b", "c", "4"), ("c", "d", "5")] and ingest._parts(spark, table) == [(0, 2)]
    (incoming / "3.json").write_text(json.dumps({"src": "d", "dst": "e", "type": "T", "properties": {}, "ord": 6}))
    ingest.merge_edges(spark, str(incoming), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert ingest.current(spark, table).count() == 4


def test_documents_and_reports(spark, records, tmp_path):
    """A graph as one document and as tables comes back as it was; rankings and the report of communities say what is there."""
    from tessera.operators import profiles
    from tessera.sources import readers, writers

    g = build.build(records)
    g = G.PropertyGraph(g.nodes, g.edges.withColumn("ord", F.monotonically_increasing_id()))
    plain = lambda x, keys: sorted(str([r[k] if not isinstance(r[k], dict) else sorted(r[k].items()) for k in keys]) for r in x.collect())
    writers.graph_document(g, str(tmp_path / "doc"))
    writers.graph_tables(g, str(tmp_path / "tables"))
    for back in (readers.graph_document(spark, str(tmp_path / "doc")), readers.graph_tables(spark, str(tmp_path / "tables"))):
        assert plain(back.nodes.withColumn("properties", F.map_filter("properties", lambda _, v: v.isNotNull())), ["id", "type", "name"]) == plain(g.nodes, ["id", "type", "name"])
        assert plain(back.edges, ["src", "dst", "type", "properties"]) == plain(g.edges, ["src", "dst", "type", "properties"])
    writers.truncated(str(tmp_path / "tables"), g)
    assert spark.read.schema(g.nodes.schema).parquet(str(tmp_path / "tables" / "nodes")).count() == 0
    d = algorithms.degrees(g.nodes, g.edges)
    writers.rankings(profiles.rankings(g.nodes, {"degree": (d, "total")}, 2), g, str(tmp_path / "rank"))
    doc = spark.read.json(str(tmp_path / "rank")).head()
    assert doc.metadata.total_nodes == 8 and [x.id for x in doc.rankings.degree["all"]] == ["pol1", "pol2"] and [x.rank for x in doc.rankings.degree.Position] == [1, 2]
    members = frame(spark, [(0, "pol1", "An", "X", "1950-01-02"), (0, "pol2", "Bình", None, None), (1, "pol3", "Cường", "X", None)], "community int, id string, name string, party string, date string")
    pairs = frame(spark, [("pol1", "pol2", 2)], "a string, b string, weight long")
    text = profiles.report(members, algorithms.community_profile(pairs, members.select("community", "id")), profiles.distribution(members, "party", "none"), profiles.connected(members, g.edges, g.nodes), algorithms.eigenvector(pairs, members.select("id", "community")), profiles.years(members), profiles.years(members.limit(0)), profiles.central_members(pairs, members))
    for said in ("Communities: 2", "COMMUNITY #1 (0)", "Members: 2", "X: 1 (50.00%)", "Position  1 of 2: Chủ tịch A: 2 (100.00%)", "1950-1950 (span: 0 years), mean 1950.0, 1", "No data", " 1. An: 1"):
        assert said in text, said
    writers.text_report(spark, text, str(tmp_path / "report"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect()) == text


def test_context(spark):
    rows = frame(spark, [(1, k, f"line {k}") for k in range(1, 9)] + [(2, 1, "x" * 2000)], "id int, rank int, text string")
    from tessera.operators import access

    got = {r.id: r.context for r in access.context(rows, "id", "text").collect()}
    assert got == {1: "line 1\nline 2\nline 3\nline 4\nline 5", 2: "x" * 1000}


def test_record_files(spark, tmp_path):
    """Records as an array over lines, as an array in one line, and as lines; parts of a dump without a root."""
    from tessera.sources import readers

    one, two = '{"title": "A", "id": "1", "infobox": {"k": "v"}}', '{"title": "B", "id": "2"}'
    for name, text in (("array.json", f"[\n{one},\n{two}\n]"), ("line.json", f"[{one}, {two}]"), ("lines.json", f"{one}\n{two}\n")):
        (tmp_path / name).write_text(text)
        assert sorted((r.title, r.id) for r in readers.records(spark, str(tmp_path / name)).collect()) == [("A", "1"), ("B", "2")], name
    page = "<page><title>{0}</title><id>1</id><revision><id>9</id><text bytes='3'>{{{{infobox|name={0}}}}}</text></revision></page>\n"
    (tmp_path / "part.xml").write_text(page.format("A") + page.format("B"))
    (tmp_path / "whole.xml").write_text("<mediawiki>" + page.format("A") + page.format("B") + "</mediawiki>")
    for name in ("part.xml", "whole.xml"):
        assert sorted(r.infobox["name"] for r in readers.infobox_records(spark, str(tmp_path / name)).collect()) == ["A", "B"], name
