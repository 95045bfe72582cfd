"""Property graphs: construction, merging and subgraphs.

nodes: id, type, name, properties (map); edges: src, dst, type, properties (map), and ord, the order in which they came.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_ci, name_key, node_code
from tessera.session import shared_dir


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame


def first_of(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def intern(mentions: DataFrame, prefixes: Column) -> DataFrame:
    """Mentions (label, name, source_id, ord) to nodes: the first mention of a name per label makes the node and its id.

    Ids count per (prefix, source), as labels may share a prefix: pos7_001.
    """
    keyed = mentions.withColumn("name_key", name_key(F.col("name"))).where("name_key <> ''")
    first = keyed.groupBy("label", "name_key").agg(F.min(F.struct("ord", "name", "source_id")).alias("m")).select("label", "name_key", "m.ord", "m.name", "m.source_id")
    first = first.withColumn("prefix", prefixes)
    n = F.row_number().over(first_of(["prefix", "source_id"], [F.col("ord"), F.col("label"), F.col("name_key")]))
    return first.select(node_code(F.col("prefix"), F.col("source_id").cast("string"), n).alias("id"), F.col("label").alias("type"), "name", "name_key")


def link(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node of each mention."""
    keyed = mentions.withColumn("name_key", name_key(F.col("name")))
    n = nodes.select(F.col("id").alias("node_id"), F.col("type").alias("label"), "name_key")
    return keyed.join(n, ["label", "name_key"])


def merge_overwrite(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type); of each property the last value."""
    each = edges.select("src", "dst", "type", "ord", F.explode_outer("properties").alias("k", "v"))
    last = each.groupBy("src", "dst", "type", "k").agg(F.max_by("v", "ord").alias("v"))
    entries = F.filter(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda e: e["k"].isNotNull())
    return last.groupBy("src", "dst", "type").agg(F.map_from_entries(entries).alias("properties"))


def merge_last(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, type): the last one whole."""
    return edges.groupBy("src", "dst", "type").agg(F.max_by("properties", "ord").alias("properties"))


def merge_with_properties(edges: DataFrame) -> DataFrame:
    """Edges that differ in their properties stay apart."""
    return edges.select("src", "dst", "type", F.to_json("properties").alias("properties")).distinct()


def insert_only(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New edges whose (src, dst, type) isn't there yet join the existing ones, each once: the first."""
    fresh = new.join(existing, ["src", "dst", "type"], "left_anti")
    fresh = fresh.groupBy("src", "dst", "type").agg(F.min_by("properties", "ord").alias("properties"))
    return existing.select("src", "dst", "type", "properties").unionByName(fresh)


def upsert(nodes: DataFrame, mentions: DataFrame, prefixes: Column) -> DataFrame:
    """Nodes with those that mentions add; known ones are marked as enriched."""
    known = nodes.withColumn("name_key", name_key(F.col("name")))
    seen = mentions.select(F.col("label").alias("type"), name_key(F.col("name")).alias("name_key")).distinct()
    marked = known.join(seen.withColumn("enriched", F.lit(True)), ["type", "name_key"], "left").select("id", "type", "name", F.coalesce("enriched", F.lit(False)).alias("enriched"))
    new = mentions.withColumn("name_key", name_key(F.col("name"))).join(known.select(F.col("type").alias("label"), "name_key"), ["label", "name_key"], "left_anti").drop("name_key")
    return marked.unionByName(intern(new, prefixes).select("id", "type", "name", F.lit(True).alias("enriched")))


def from_triplets(triplets: DataFrame) -> DataFrame:
    """subject, predicate, object to edges; rows without an end go."""
    return triplets.where("subject is not null and object is not null").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("predicate").alias("type"), "properties")


def connected(graph: PropertyGraph) -> DataFrame:
    """Edges whose ends both exist."""
    ids = graph.nodes.select("id")
    return graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def subgraph(graph: PropertyGraph, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> PropertyGraph:
    """What is left of nodes and edges of some types."""
    nodes = graph.nodes.where(F.col("type").isin(node_types)) if node_types else graph.nodes
    edges = graph.edges.where(F.col("type").isin(edge_types)) if edge_types else graph.edges
    return PropertyGraph(nodes, connected(PropertyGraph(nodes, edges)))


def undirected(edges: DataFrame) -> DataFrame:
    """The simple undirected graph: a < b, each pair once, no loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def named(graph: PropertyGraph, edges: DataFrame | None = None) -> DataFrame:
    """Edges with the names and types of both ends."""
    n = graph.nodes
    e = graph.edges if edges is None else edges
    s = n.select(F.col("id").alias("src"), F.col("name").alias("src_name"), F.col("type").alias("src_type"))
    d = n.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"), F.col("type").alias("dst_type"))
    return e.join(s, "src").join(d, "dst")


def co_members(edges: DataFrame) -> DataFrame:
    """Pairs a < b of sources that share a target, with the number of targets."""
    m = cut(edges.select("src", "dst").distinct())  # read as written, so that the engine can split the rows of a popular target
    pairs = m.withColumnRenamed("src", "a").join(m.withColumnRenamed("src", "b"), "dst").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def successions(terms: DataFrame) -> DataFrame:
    """Edges between neighbours in a position's order: SUCCEEDED to the one before, PRECEDED to the one after.

    terms: holder, position, and ord, the order in the position.
    """
    w = Window.partitionBy("position").orderBy("ord", "holder")
    t = terms.select("holder", "position", F.lag("holder").over(w).alias("before"), F.lead("holder").over(w).alias("after"))
    edge = lambda other, kind: t.where(F.col(other).isNotNull()).select(F.col("holder").alias("src"), F.col(other).alias("dst"), F.lit(kind).alias("type"), F.col("position").alias("position_id"))
    return edge("before", "SUCCEEDED").unionByName(edge("after", "PRECEDED"))


def resolve_names(mentions: DataFrame, nodes: DataFrame, key: Column, node_key: Column) -> DataFrame:
    """Mentions of persons by name to ids; of equal names the last node counts."""
    ids = nodes.withColumn("_key", node_key).groupBy("_key").agg(F.max("id").alias("node_id"))
    return mentions.withColumn("_key", key).join(ids, "_key").drop("_key")


def valid_successions(edges: DataFrame, served: DataFrame) -> DataFrame:
    """Succession edges both of whose ends held the edge's position. served: holder, position."""
    s = served.select("holder", "position").distinct()
    return edges.join(s, (F.col("src") == s["holder"]) & (F.col("position_id") == s["position"]), "left_semi").join(s, (F.col("dst") == s["holder"]) & (F.col("position_id") == s["position"]), "left_semi")


def grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a lower-cased text."""
    low = F.lower(text)
    return F.when(F.length(low) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def succession_by_name(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst_name, type) to every node whose name contains the name.

    A name that holds another holds all its runs of three characters (of two or one, if it is so short), so the two meet at
    the run that fewest nodes have; then the whole decides. Cases: an empty name is in none; nodes without name have no edge.
    """
    lengths = (1, 2, 3)
    have = F.flatten(F.array(*[grams(F.col("name"), k) for k in lengths]))
    keyed = cut(nodes.where("name is not null").select("id", "name", F.explode(F.array_distinct(have)).alias("gram")))
    often = cut(keyed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    size = F.least(F.length("dst_name"), F.lit(max(lengths)))
    own = F.when(size == 3, grams(F.col("dst_name"), 3)).when(size == 2, grams(F.col("dst_name"), 2)).otherwise(grams(F.col("dst_name"), 1))
    wanted = edges.select("dst_name").where("dst_name <> ''").distinct()
    rarest = wanted.select("dst_name", F.explode(own).alias("gram")).join(often, "gram", "left")
    rarest = cut(rarest.groupBy("dst_name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0").select("dst_name", "m.gram"))
    found = rarest.join(keyed, "gram").where(contains_ci(F.col("name"), F.col("dst_name"))).select("dst_name", "id")
    return edges.join(cut(found), "dst_name").select("src", F.col("id").alias("dst"), "type")


def merged_text(values: Column) -> Column:
    """Values one after another with "; ", without those that the text so far contains."""
    return F.aggregate(values, F.lit(None).cast("string"), lambda acc, v: F.when(acc.isNull(), v).when(F.contains(acc, v), acc).otherwise(F.concat(acc, F.lit("; "), v)))


def expand(seeds: DataFrame, refs: DataFrame, allowed: DataFrame, depth: int) -> DataFrame:
    """Breadth-first from seeds (id) over refs (src, dst) to allowed nodes (id): id and the step at which it was found.

    A step joins only what the last one found; its table is written, so the plan doesn't grow with the depth.
    """
    found = seeds.join(allowed.select("id"), "id", "left_semi").select("id").distinct().withColumn("depth", F.lit(0))
    frontier = found
    for step in range(1, depth + 1):
        reached = frontier.join(refs, frontier["id"] == refs["src"]).select(F.col("dst").alias("id")).distinct()
        new = reached.join(allowed.select("id"), "id", "left_semi").join(found.select("id"), "id", "left_anti")
        frontier = cut(new.withColumn("depth", F.lit(step)))
        found = found.unionByName(frontier)
        if frontier.isEmpty():
            break
    return found


def bucketed(df: DataFrame, by: list[str], dealt: bool = False) -> tuple[DataFrame, str]:
    """df as a table in as many buckets by these columns as spark.sql.shuffle.partitions, and its name: joins on them read it without a
    shuffle. dealt: the last grouping or join of df was by these columns, so its rows are written where they are. unbucketed() drops
    the table when its use is over; else its files go when the application ends."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"tessera_buckets_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (df if dealt else df.repartition(n, *by)).write.bucketBy(n, *by).option("path", path).format("parquet").saveAsTable(name)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.table(name), name


def unbucketed(spark: SparkSession, *names: str) -> None:
    """Drop tables of bucketed() and delete their files: nothing that reads them is run any more."""
    for name in names:
        spark.sql(f"DROP TABLE {name}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


#: Rows of a table that one task sorts or groups, about.
ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df, which has so many rows or fewer, by these columns in parts of some ROWS, if spark.sql.shuffle.partitions are too few for that:
    the memory of a task that sorts or groups it by them then doesn't grow with the table."""
    n = -(-rows // ROWS)
    return df.repartition(n, *by) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names (a local session without one gets its own), read again.

    A table has a size that Spark knows; a checkpoint keeps the estimate of the plan that made it, which an iteration that
    joins its state with itself squares in each round. The table goes when the application ends; that of `instead_of`, what
    an earlier call returned, goes now, as an iteration doesn't read it any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_cut = path
    if instead_of is not None:
        drop(instead_of)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these: nothing that reads them is run any more."""
    for t in tables:
        if hasattr(t, "_tessera_cut"):
            sc = t.sparkSession.sparkContext
            old = sc._jvm.org.apache.hadoop.fs.Path(t._tessera_cut)
            old.getFileSystem(sc._jsc.hadoopConfiguration()).delete(old, True)
