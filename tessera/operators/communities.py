"""Communities of weighted graphs by joins: Louvain's moves and contractions, and the merge of small communities.

Nothing of the graph comes to the driver: it holds one modularity a sweep and one count a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import cut
from tessera.operators.questions import renumbered

#: Sweeps over all nodes of a level at most; a level also ends when a sweep gains less than LEAST_GAIN of modularity.
SWEEPS, LEAST_GAIN = 12, 1e-5


def louvain(nodes: DataFrame, pairs: DataFrame, resolution: float = 1.0, seed: int = 42, smallest: int = 0) -> DataFrame:
    """id, community of a weighted simple graph (a, b, weight; a loop has a = b): 0 is the largest community, of equal ones that with the least id.

    In a round half of the nodes, by a seeded hash, look at once at the communities of their neighbours and go to that of
    highest gain (of equal gains their own, else the least), the other half in the next round. When a sweep of two rounds
    gains nothing more, communities become nodes, and the same begins with these. Communities below `smallest` members
    are merged, see `merged`. The same input and seed give the same rows. Cases: nodes without links are communities of their
    own; pairs that come more than once add up; a graph without links has as many communities as nodes.
    """
    links = pairs.select(F.col("a"), F.col("b"), F.col("weight").cast("double").alias("weight"))
    near, own = _level(links.unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    own = cut(nodes.select("id").distinct().join(own, "id", "left").select("id", F.coalesce("own", F.lit(0.0)).alias("own")))
    place = own.select("id", F.col("id").alias("community"))
    while True:
        member, n, left = _moved(near, own, resolution, seed)
        place = cut(place.join(member.select(F.col("id").alias("community"), F.col("community").alias("up")), "community").select("id", F.col("up").alias("community")))
        if left in (n, 1):
            break
        of = member.select("id", "community")
        up = near.join(of, "id").select(F.col("community").alias("a"), F.col("near"), "weight").join(of.withColumnsRenamed({"id": "near", "community": "b"}), "near").select("a", "b", "weight")
        inner = own.join(of, "id").groupBy("community").agg(F.sum("own").alias("own")).select(F.col("community").alias("a"), F.col("community").alias("b"), F.col("own").alias("weight"))
        near, own = _level(up.select("a", "b", F.when(F.col("a") == F.col("b"), F.col("weight") / 2).otherwise(F.col("weight")).alias("weight")).unionByName(inner))
        own = cut(of.select(F.col("community").alias("id")).distinct().join(own, "id", "left").select("id", F.coalesce("own", F.lit(0.0)).alias("own")))
    return numbered(merged(place, pairs, smallest) if smallest else place)


def _level(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links a, b, weight in both directions to what a level reads: id, near, weight without loops, and the loops as id, own."""
    each = cut(links.groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    return each.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("near"), "weight"), each.where("a = b").select(F.col("a").alias("id"), F.col("weight").alias("own"))


def _moved(near: DataFrame, own: DataFrame, resolution: float, seed: int) -> tuple[DataFrame, int, int]:
    """id, community after a level's moves, the number of nodes and that of communities."""
    strength = near.groupBy("id").agg(F.sum("weight").alias("out"))
    member = cut(own.join(strength, "id", "left").select("id", F.col("id").alias("community"), (F.coalesce("out", F.lit(0.0)) + 2 * F.col("own")).alias("k")))
    n, m2 = member.agg(F.count(F.lit(1)), F.coalesce(F.sum("k"), F.lit(0.0))).head()
    if not m2:
        return member, n, n
    loops = 2 * own.agg(F.coalesce(F.sum("own"), F.lit(0.0))).head()[0]
    best, most, left = member, None, n
    for sweep in range(SWEEPS):
        for half in (0, 1):
            member = _round(near, member, m2, resolution, F.pmod(F.xxhash64(F.lit(seed), F.lit(sweep), "id"), F.lit(2)) == half)
        quality, now = _quality(near, member, m2, loops, resolution)
        if most is not None and quality < most + LEAST_GAIN:
            return (member, n, now) if quality > most else (best, n, left)
        best, most, left = member, quality, now
    return best, n, left


def _round(near: DataFrame, member: DataFrame, m2: float, resolution: float, turn: Column) -> DataFrame:
    """Members after those whose turn it is have moved. Of two nodes that are communities of their own only the greater goes to the other, so that none swap."""
    total = member.groupBy("community").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    movers = member.where(turn)  # only their links are followed
    there = near.where(turn).join(member.select(F.col("id").alias("near"), "community"), "near").select("id", "community", "weight")
    choice = there.unionByName(movers.select("id", "community", F.lit(0.0).alias("weight"))).groupBy("id", "community").agg(F.sum("weight").alias("w"))
    choice = choice.join(total, "community").join(movers.select("id", F.col("community").alias("mine"), "k"), "id")
    stays = F.col("community") == F.col("mine")
    gain = F.col("w") - resolution * F.col("k") / m2 * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0))
    best = choice.groupBy("id").agg(F.min_by(F.struct("community", "size"), F.struct(-F.round(gain, 9), ~stays, "community")).alias("to"), F.max(F.when(stays, F.col("size"))).alias("size"), F.max("mine").alias("community"))
    swap = (F.col("to.size") == 1) & (F.col("size") == 1) & (F.col("to.community") > F.col("community"))
    goes = best.where(~swap).select("id", F.col("to.community").alias("new"))
    return cut(member.join(goes, "id", "left").select("id", F.coalesce("new", "community").alias("community"), "k"))


def _quality(near: DataFrame, member: DataFrame, m2: float, loops: float, resolution: float) -> tuple[float, int]:
    """Modularity, and the number of communities."""
    a, b = (member.select(F.col("id").alias(x), F.col("community").alias(c)) for x, c in (("id", "c"), ("near", "d")))
    inner = near.join(a, "id").join(b, "near").where("c = d").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inner"))
    totals = member.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.pow(F.col("k") / m2, 2)).alias("square"), F.count(F.lit(1)).alias("n"))
    r = inner.join(F.broadcast(totals)).head()  # a row each
    return (r.inner + loops) / m2 - resolution * r.square, r.n


def merged(place: DataFrame, pairs: DataFrame, smallest: int) -> DataFrame:
    """id, community (a name) after communities below `smallest` members have joined others: the smallest first (of equal ones the least
    name), each the one that most of its members' links lead to (of equal ones the least name); those without links then the largest.

    One at a time would be as many rounds as small communities. A community's choice only waits for smaller ones that it is linked
    to, so in a round all go that have none of these: no two of them are linked, and the result is the same.
    """
    at = lambda x, c: place.select(F.col("id").alias(x), F.col("community").alias(c))
    each = pairs.where("a <> b").select("a", "b").distinct().join(at("a", "c"), "a").join(at("b", "d"), "b").where("c <> d")
    links = cut(each.select("c", "d").unionByName(each.select(F.col("d").alias("c"), F.col("c").alias("d"))).groupBy("c", "d").agg(F.count(F.lit(1)).alias("n")))
    sizes = cut(place.groupBy("community").agg(F.count(F.lit(1)).alias("size")))
    while True:
        small = sizes.where(F.col("size") < smallest)
        if small.isEmpty() or sizes.limit(2).count() < 2:
            return place
        linked = links.join(small.select(F.col("community").alias("c"), F.col("size").alias("sc")), "c")
        before = F.struct("sd", "d") < F.struct("sc", "c")
        waits = linked.join(small.select(F.col("community").alias("d"), F.col("size").alias("sd")), "d").where(before).select("c").distinct()
        to = cut(linked.join(waits, "c", "left_anti").groupBy("c").agg(F.min_by("d", F.struct(-F.col("n"), F.col("d"))).alias("to")))
        if to.isEmpty():  # what is small has no links
            largest = sizes.orderBy(F.desc("size"), "community").limit(1).select(F.col("community").alias("to"))
            to = cut(small.select(F.col("community").alias("c")).join(F.broadcast(largest)).where("c <> to"))  # a row
        renamed = lambda df, column: df.join(to.withColumnRenamed("c", column), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")  # noqa: E731, B023
        place = cut(renamed(place, "community"))
        sizes = cut(renamed(sizes, "community").groupBy("community").agg(F.sum("size").alias("size")))
        links = cut(renamed(renamed(links, "c"), "d").where("c <> d").groupBy("c", "d").agg(F.sum("n").alias("n")))


def numbered(place: DataFrame) -> DataFrame:
    """id, community as a number: 0 for the largest, of equal ones for that with the least id."""
    sizes = place.groupBy("community").agg((-F.count(F.lit(1))).alias("less"), F.min("id").alias("first"))
    number = renumbered(sizes, ["less", "first"], 0, "number").select("community", F.col("number").cast("int").alias("number"))
    return place.join(number, "community").select("id", F.col("number").alias("community"))
