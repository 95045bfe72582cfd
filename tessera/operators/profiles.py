"""What the members of communities have in common, and reports of it. Members: community, id, name, and more where asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import dates
from tessera.operators.graph import spread


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by the order, with their rank from 1; first within partitions, so that no task sees all rows of a group."""
    own = rows.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))).where(F.col("_n") <= k).drop("_part", "_n")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def share_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows (community, count) with percentage: of the community's members."""
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("_size"))
    return rows.join(size, "community").withColumn("percentage", F.round(100.0 * F.col("count") / F.col("_size"), 2)).drop("_size")


def distribution(members: DataFrame, column: str, missing: str = C.DEFAULT_PARTY) -> DataFrame:
    """community, the column's values, count, percentage."""
    rows = members.withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(missing)))
    return share_of(rows.groupBy("community", column).agg(F.count(F.lit(1)).alias("count")), members)


def connected(members: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """community, type, name, count (members with an edge to a node of that name), percentage, total (names of the type), rank: the k most common of each type."""
    rows = edges.count()
    to = spread(edges.select("src", "dst"), rows, "dst").join(nodes.select(F.col("id").alias("dst"), "type", "name"), "dst").select("src", "type", "name")
    to = spread(to, rows, "src").distinct().join(members.select("community", F.col("id").alias("src")).distinct(), "src")
    counts = to.groupBy("community", "type", "name").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("community", "type").agg(F.count(F.lit(1)).alias("total"))
    best = top(counts, ["community", "type"], [F.desc("count"), F.col("name")], k)
    return share_of(best.join(totals, ["community", "type"]), members)


def years(values: DataFrame, column: str = "date") -> DataFrame:
    """community, first, last, mean, count of the years in a column's texts; values without a year are left out."""
    y = values.select("community", dates.first_year(F.col(column)).alias("y")).where("y is not null")
    return y.groupBy("community").agg(F.min("y").alias("first"), F.max("y").alias("last"), F.round(F.avg("y"), 1).alias("mean"), F.count(F.lit(1)).alias("count"))


def central_members(pairs: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """community, id, name, degree, rank: the k members with most links inside their community. pairs: a, b."""
    c = members.select("community", "id")
    inside = pairs.select("a", "b").join(c.toDF("community", "a"), "a").join(c.toDF("other", "b"), "b").where("community = other")
    degree = inside.select("community", F.explode(F.array("a", "b")).alias("id")).groupBy("community", "id").agg(F.count(F.lit(1)).alias("degree"))
    return top(degree.join(members.select("id", "name"), "id"), ["community"], [F.desc("degree"), F.col("id")], k)


def report(members: DataFrame, basics: DataFrame, parties: DataFrame, common: DataFrame, eigen: DataFrame, births: DataFrame, terms: DataFrame, leaders: DataFrame) -> str:
    """The text of a community report in eight sections. All frames have a few rows for each community, and those are collected.

    basics: algorithms.community_profile; parties: distribution; common: connected; eigen: id, community, eigenvector; births and
    terms: years; leaders: central_members. Communities come by size.
    """
    name = members.select("id", "name")
    of = lambda frame: _by_community(frame)
    best = eigen.join(name, "id").groupBy("community").agg(F.max_by(F.struct("name", "eigenvector"), F.struct("eigenvector", "id")).alias("best")).select("community", "best.*")
    b, p, c, e, y, t, m = (of(x) for x in (basics, parties.orderBy(F.desc("count")), common.orderBy("type", "rank"), best, births, terms, leaders.orderBy("rank")))
    out = [f"Communities: {len(b)}", ""]
    for i, (key, (base, *_)) in enumerate(sorted(b.items(), key=lambda x: (-x[1][0]["nodes"], x[0])), 1):
        out += [f"COMMUNITY #{i} ({key})", "1. BASIC INFO", f"Members: {base['nodes']}", f"Edges: {base['edges']}", f"Density: {base['density']:.4f}", "2. PARTY DISTRIBUTION"]
        out += [f"  {r[parties.columns[1]]}: {r['count']} ({r['percentage']:.2f}%)" for r in p.get(key, [])] + ["3. CONNECTED NODES"]
        out += [f"  {r['type']} {r['rank']:2d} of {r['total']}: {r['name']}: {r['count']} ({r['percentage']:.2f}%)" for r in c.get(key, [])]
        out += ["4. CENTRAL NODE (Degree)", *[f"  {r['name']}: {r['degree']}, {base['top_centrality']:.4f}" for r in m.get(key, [])[:1]], "5. CENTRAL NODE (Eigenvector)", *[f"  {r['name']}: {r['eigenvector']:.4f}" for r in e.get(key, [])]]
        for title, found in (("6. BIRTH YEAR STATS", y), ("7. TERM START STATS", t)):
            out += [title, *([f"  {r['first']}-{r['last']} (span: {r['last'] - r['first']} years), mean {r['mean']:.1f}, {r['count']}" for r in found.get(key, [])] or ["  No data"])]
        out += ["8. TOP CONNECTED MEMBERS", *[f"  {r['rank']:2d}. {r['name']}: {r['degree']}" for r in m.get(key, [])], ""]
    return "\n".join(out)


def _by_community(frame: DataFrame) -> dict:
    out: dict = {}
    for r in frame.collect():
        out.setdefault(r["community"], []).append(r.asDict())
    return out


def rankings(nodes: DataFrame, measures: dict[str, tuple[DataFrame, str]], k: int = 20, types: tuple[str, ...] = ("Politician", "Position")) -> DataFrame:
    """measure, of ('all' or a type), rank, id, name, type, score: the k best of each measure (frame with id, its column), overall and by type."""
    out = None
    for measure, (frame, column) in measures.items():
        scored = frame.select("id", F.col(column).alias("score")).join(nodes.select("id", "name", "type"), "id").withColumn("of", F.explode(F.array(F.lit("all"), "type"))).where(F.col("of").isin("all", *types))
        best = top(scored, ["of"], [F.desc(F.round("score", 12)), F.col("id")], k).select(F.lit(measure).alias("measure"), "of", "rank", "id", "name", "type", "score")
        out = best if out is None else out.unionByName(best)
    return out
