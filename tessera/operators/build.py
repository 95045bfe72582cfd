"""Records to a property graph in one call: persons, what they mention, and who followed whom."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import text
from tessera.operators import graph as G
from tessera.operators import records as R
from tessera.sources import readers

EDGES = ["src", "dst", "type", "properties"]


def prefixes():
    """The prefix of the ids of a label's nodes."""
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(C.LABEL_PREFIX.items())])[F.col("label")]


def people_of(records: DataFrame, people: DataFrame) -> DataFrame:
    """record_id and the id of its person: records of one title are one person."""
    keyed = records.select(F.col("id").alias("record_id"), text.name_key(F.col("title")).alias("name_key"))
    return keyed.join(people.select("name_key", F.col("id").alias("person")), "name_key").select("record_id", "person")


def mention_edges(records: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of all that records mention (id, type, name, name_key), and an edge for each mention, with record_id and slot."""
    said = R.mentions(records).select("record_id", "edge", "label", "name", "properties", F.col("record_id").alias("source_id"), F.struct("record_id", "ord").alias("ord"))
    said = G.cut(said)  # read for the nodes and for the edges
    nodes = G.cut(G.intern(said, prefixes()))  # a table: mentions aren't shuffled for few names
    linked = G.link(said, nodes).join(people_of(records, people), "record_id")
    return nodes, linked.select(F.col("person").alias("src"), F.col("node_id").alias("dst"), F.col("edge").alias("type"), "properties", "record_id", F.col("ord.ord").alias("slot"))


def succession_edges(records: DataFrame, people: DataFrame, served: DataFrame, links_only: bool = False) -> DataFrame:
    """SUCCEEDED to the predecessors and PRECEDED to the successors that a record's offices name, where they are persons.

    Names are those of links; without links those of the plain text, unless `links_only`. served: record_id, slot, dst, the
    position of each office, which becomes the edge's position_id. Persons are known whatever the order of the records.
    """
    names = lambda said: F.when(said.isNotNull() & ~text.ignored(said), _names(said, links_only))
    each = lambda kind, said: F.transform(F.coalesce(names(F.col(said)), F.array().cast("array<string>")), lambda n: F.struct(F.lit(kind).alias("type"), n.alias("name")))
    slots = R.slots(records).select("record_id", "slot", F.concat(each("SUCCEEDED", "predecessor"), each("PRECEDED", "successor")).alias("said"))
    # an office's person and position are found before it becomes a row for each name; inline would have its list made twice, for a filter before the joins
    at = served.select("record_id", "slot", F.col("dst").alias("position_id"))
    slots = slots.join(people_of(records, people).withColumnRenamed("person", "src"), "record_id").join(at, ["record_id", "slot"], "left")
    found = slots.select("src", "position_id", F.inline_outer("said")).where("name is not null").withColumn("name_key", text.name_key(F.col("name"))).join(people.select("name_key", F.col("id").alias("dst")), "name_key")
    properties = F.map_filter(F.create_map(F.lit("position_id"), F.col("position_id")), lambda _, v: v.isNotNull())
    return found.select("src", "dst", "type", properties.alias("properties"))


def _names(said: Column, links_only: bool) -> Column:
    """The names in a field of an office: those of links, without links those of the plain text unless `links_only`."""
    linked = text.link_targets(said)
    return linked if links_only else F.get(F.transform(F.array(linked), lambda l: F.when(F.size(l) > 0, l).otherwise(text.plain_names(said))), 0)


def build(records: DataFrame, links_only: bool = False) -> G.PropertyGraph:
    """The graph of clean records with lists (records.cleaned, records.with_lists): persons, all that they mention, and their edges.

    Of two records with one title the first by id makes the person, and the edges of both are that person's. Cases: no
    records give an empty graph; a record without title makes no person, and its mentions nodes without edges from it.
    """
    # read for persons, mentions and offices, so what makes them is run once; in many files, as their texts take long for their size
    records = G.cut(records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"))
    people = G.cut(R.persons(records))
    nodes, mentioned = mention_edges(records, people)
    mentioned = G.cut(mentioned)
    followed = succession_edges(records, people, mentioned.where("type = 'SERVED_AS'"), links_only)
    none = F.expr("cast(map() as map<string,string>)")
    every = people.select("id", "type", "name", "properties").unionByName(nodes.select("id", "type", "name", none.alias("properties")))
    return G.PropertyGraph(every, mentioned.select(*EDGES).unionByName(followed.select(*EDGES)))


def flat(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with these properties as columns and without their type, as a store's import takes them."""
    return nodes.select("id", "name", *[F.try_element_at("properties", F.lit(k)).alias(k) for k in keys])


#: Of an extraction's list of structs: edge type, label, what names the node, and properties of the edge.
_EXTRACTED = {
    "positions": ("SERVED_AS", "Position", ("term_start", "term_end", "status", "reason")),
    "alma_mater": ("ALUMNUS_OF", "AlmaMater", ()),
    "military_careers": ("SERVED_IN", "MilitaryCareer", ("year_start", "year_end")),
    "military_ranks": ("HAS_RANK", "MilitaryRank", ()),
    "awards": ("AWARDED", "Award", ("year",)),
    "campaigns": ("FOUGHT_IN", "Campaigns", ("year",)),
    "academic_titles": ("HAS_ACADEMIC_TITLE", "AcademicTitle", ()),
}
#: Fixed value: a summary shorter than this is not sent to a model.
LEAST_SUMMARY = 50


def worth_extracting(records: DataFrame) -> DataFrame:
    """Records whose summary is long enough to be sent to a model."""
    return records.where(long_enough(F.col("summary")))


def long_enough(summary: Column) -> Column:
    return F.length(F.trim(F.coalesce(summary, F.lit("")))) >= LEAST_SUMMARY


def extraction_stage(records: DataFrame, responses: DataFrame) -> DataFrame:
    """id, status, attempts, answer of records (id, summary, and more): what a model's responses give for each.

    responses: record_id, attempt, reply (null where the call failed). The first attempt whose reply holds an extraction counts, as a
    call is made again after a quota error or a reply that isn't JSON. status: short (the summary isn't sent), waiting (no response yet),
    failed (no attempt holds one), extracted. Each record has a row, so that a later run takes those that wait or failed.
    """
    tried = responses.withColumn("_answer", readers.extracted(F.col("reply")))
    best = tried.groupBy("record_id").agg(F.count(F.lit(1)).alias("attempts"), F.min_by("_answer", F.when(F.col("_answer").isNotNull(), F.col("attempt"))).alias("answer"))
    rows = records.select("id", long_enough(F.col("summary")).alias("_sent")).join(best, F.col("id") == F.col("record_id"), "left")
    status = F.when(~F.col("_sent"), "short").when(F.col("attempts").isNull(), "waiting").when(F.col("answer").isNull(), "failed").otherwise("extracted")
    answer = F.when(F.col("_sent"), F.col("answer"))
    return rows.select("id", status.alias("status"), F.when(F.col("_sent"), F.coalesce("attempts", F.lit(0))).otherwise(0).alias("attempts"), answer.alias("answer"))


def extracted_mentions(extractions: DataFrame) -> DataFrame:
    """person, edge, label, name, properties, ord of what a model found in texts. extractions: person (node id), answer (struct of arrays, or null)."""
    out, fields = None, {f.name: f.dataType.elementType.fieldNames() for f in extractions.schema["answer"].dataType}
    none = F.expr("cast(map() as map<string,string>)")
    for at, (field, (edge, label, keys)) in enumerate(_EXTRACTED.items()):
        if field not in fields:
            continue
        pairs = [x for k in keys if k in fields[field] for x in (F.lit(k), F.col(f"x.{k}"))]
        properties = F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda _, v: v.isNotNull() & (F.trim(v) != "")) if pairs else none
        rows = extractions.select("person", F.posexplode(f"answer.{field}").alias("i", "x"))
        rows = rows.select("person", F.lit(edge).alias("edge"), F.lit(label).alias("label"), F.trim("x.name").alias("name"), properties.alias("properties"), (F.lit(at * 1000) + F.col("i")).alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    if "locations" in fields:
        kind = F.when(F.lower("x.relation").rlike("died|death|mất"), "DIED_AT").otherwise("BORN_AT")
        rows = extractions.select("person", F.posexplode("answer.locations").alias("i", "x")).select("person", kind.alias("edge"), F.lit("Location").alias("label"), F.trim("x.name").alias("name"), none.alias("properties"), (F.lit(9000) + F.col("i")).alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out.where("name is not null and name <> ''")


def enriched(graph: G.PropertyGraph, extractions: DataFrame) -> tuple[G.PropertyGraph, DataFrame]:
    """The graph with what a model extracted, and the log of it: person, edge, label, name, node, new_node, new_edge.

    A name that a node of its label has leads to that node, else to a new one; edges that are there stay as they are.
    """
    said = extracted_mentions(extractions).join(graph.nodes.select(F.col("id").alias("person")), "person", "left_semi")
    said = G.cut(said.withColumn("name_key", text.name_key(F.col("name"))))
    known = graph.nodes.select(F.col("type").alias("label"), text.name_key(F.col("name")).alias("name_key"), "id").groupBy("label", "name_key").agg(F.min("id").alias("known"))
    fresh = said.join(known, ["label", "name_key"], "left_anti").select("label", "name", F.concat(F.lit("x"), "person").alias("source_id"), F.struct("person", "ord").alias("ord"))
    made = G.cut(G.intern(fresh, prefixes()))
    of = said.join(known, ["label", "name_key"], "left").join(made.select(F.col("type").alias("label"), "name_key", F.col("id").alias("made")), ["label", "name_key"], "left").withColumn("node", F.coalesce("known", "made"))
    new = of.select(F.col("person").alias("src"), F.col("node").alias("dst"), F.col("edge").alias("type"), "properties", "ord")
    there = graph.edges.select("src", "dst", "type").distinct().withColumn("there", F.lit(True))
    log = of.join(there.toDF("person", "node", "edge", "there"), ["person", "node", "edge"], "left").select("person", "edge", "label", "name", "node", F.col("known").isNull().alias("new_node"), F.col("there").isNull().alias("new_edge"))
    nodes = graph.nodes.select("id", "type", "name", "properties").unionByName(made.select("id", "type", "name", F.create_map(F.lit("source"), F.lit("enrichment")).alias("properties")))
    return G.PropertyGraph(nodes, G.insert_only(graph.edges, new)), log


def log_counts(log: DataFrame) -> DataFrame:
    """label, mentions, new nodes and new edges of an enrichment."""
    return log.groupBy("label").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct(F.when(F.col("new_node"), F.col("node"))).alias("nodes"), F.count_distinct(F.when(F.col("new_edge"), F.struct("person", "node", "edge"))).alias("edges"))
