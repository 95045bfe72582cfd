"""Reading pages, records, graphs and question files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text, wikitext
from tessera.functions.answers import json_or_null, parsed
from tessera.operators.graph import PropertyGraph

PAGE = "title string, id bigint, revision struct<id:bigint,text:struct<_VALUE:string>>"
RECORD = "title string, id string, template string, infobox map<string,string>, summary string"
NODE = "struct<id:string,type:string,name:string,properties:map<string,string>>"
EDGE = "struct<`from`:string,`to`:string,type:string,properties:map<string,string>>"
GRAPH = f"metadata struct<created_at:string,total_nodes:bigint,total_edges:bigint,node_types:array<string>,edge_types:array<string>>, nodes map<string,array<{NODE}>>, edges map<string,array<{EDGE}>>"
EXTRACTION = (
    "positions array<struct<name:string,organization:string,term_start:string,term_end:string,status:string,reason:string>>, locations array<struct<name:string,relation:string>>, "
    "alma_mater array<struct<name:string>>, military_careers array<struct<name:string,year_start:string,year_end:string>>, military_ranks array<struct<name:string>>, awards array<struct<name:string,year:string>>, "
    "campaigns array<struct<name:string,year:string>>, academic_titles array<struct<name:string>>, succession_relations array<struct<person_name:string,relation_type:string,position:string,context:string>>"
)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """title, id, text of a MediaWiki dump's pages; files may be parts of a dump, without its root element."""
    # the other parser takes one root element a file and stops after it
    rows = spark.read.format("xml").option("rowTag", "page").option("useLegacyXMLParser", "true").schema(PAGE).load(path)
    return rows.select("title", "id", F.col("revision.text._VALUE").alias("text"))


def page(spark: SparkSession, path: str, title: str) -> DataFrame:
    return pages(spark, path).where(F.col("title") == title).limit(1)


def infobox_records(spark: SparkSession, path: str) -> DataFrame:
    """title, id, template, infobox of the pages that have one."""
    rows = pages(spark, path).select("title", F.col("id").cast("string").alias("id"), wikitext.infobox(F.col("text")).alias("x"))
    return rows.where("x.template <> 'NOT_FOUND' and size(x.infobox) > 0").select("title", "id", "x.template", "x.infobox")


def records(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Records of JSON lines, or of a JSON array a file. Without `lines` each file is told by its first line that isn't blank, in a pass
    over the texts: a whole object begins lines, all else an array; a folder may hold both. No file or blank ones give no records."""
    read = lambda at, lines: spark.read.schema(RECORD).json(at, multiLine=not lines)
    if lines is not None:
        return read(path, lines)
    texts = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"), F.trim("value").alias("v")).where("v <> ''")
    first = texts.groupBy("file").agg(F.min_by("v", "at").alias("v"))
    told = first.select(F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("file"), F.col("v").rlike(r"^\{.*\}$").alias("lines")).collect()  # a row per file
    files = {kind: [r.file for r in told if r.lines == kind] for kind in (True, False)}
    if files[True] and files[False]:
        return read(files[True], True).unionByName(read(files[False], False))
    return read(path, bool(files[True]))


def graph_document(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from one JSON document: all edges, in their order."""
    doc = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = doc.select(F.explode("nodes").alias("label", "xs")).select(F.inline("xs"))
    edges = doc.select(F.posexplode(F.map_entries("edges")).alias("g", "e")).select("g", F.posexplode("e.value").alias("i", "x"))
    return PropertyGraph(nodes, edges.select(F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.type", F.coalesce("x.properties", F.expr("cast(map() as map<string,string>)")).alias("properties"), (F.col("g").cast("bigint") * (1 << 40) + F.col("i")).alias("ord")))


def graph_tables(spark: SparkSession, path: str) -> PropertyGraph:
    """A graph from its Parquet tables: nodes with an id, edges with both."""
    return PropertyGraph(spark.read.parquet(f"{path}/nodes").where("id is not null"), spark.read.parquet(f"{path}/edges").where("src is not null and dst is not null"))


def question_graph(graph: PropertyGraph) -> PropertyGraph:
    """Nodes with a name_key; of edges of one type between two nodes the last."""
    from tessera.operators.graph import merge_last

    return PropertyGraph(graph.nodes.withColumn("name_key", text.name_key_loose(F.col("name"))), merge_last(graph.edges))


def names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''").distinct()


def csv_pair(spark: SparkSession, questions: str, answers: str) -> DataFrame:
    """Questions and their answers, by id; questions may hold line breaks."""
    read = lambda p, s: spark.read.csv(p, header=True, multiLine=True, escape='"', schema=s)
    q = read(questions, "id int, question string, hop_count int, reasoning_path string, variant_type string")
    return q.join(read(answers, "id int, answer string"), "id")


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON files, also with commas before closing brackets. One column, doc; null where neither way parses."""
    raw = spark.read.text(path, wholetext=True)
    fixed = F.regexp_replace("value", r",(\s*[}\]])", "$1")
    return raw.select(F.coalesce(json_or_null(F.col("value"), schema), json_or_null(fixed, schema)).alias("doc"))


def preferred_files(spark: SparkSession, path: str, suffix: str = "_cleaned") -> list[str]:
    """The JSON files of a folder; of a file and its cleaned form the latter."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(s.getPath().toString()) for s in fs.listStatus(fs_path) if s.getPath().getName().endswith(".json"))
    stems = {p.removesuffix(".json") for p in found}
    return [p for p in found if p.removesuffix(".json") + suffix not in stems]


def extractions(replies: DataFrame, column: str = "reply") -> DataFrame:
    """Model replies with their extraction against the declared schema."""
    return replies.withColumn("extraction", extracted(F.col(column)))


def extracted(reply: Column) -> Column:
    """The extraction in a model's reply against the declared schema; null where there is none."""
    return parsed(reply, EXTRACTION)


def remaining(rows: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows that an earlier run hasn't done, by id; at most `limit` if a run takes portions."""
    left = rows.join(done.select("id"), "id", "left_anti")
    return left.orderBy("id").limit(limit) if limit is not None else left
