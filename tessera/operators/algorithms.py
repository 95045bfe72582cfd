"""Graph analytics. Iterations are joins and aggregations over written frontiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import bucketed, cut, unbucketed
from tessera.operators.questions import renumbered


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, total; parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    d = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return nodes.select("id").join(d, "id", "left").select("id", zero(F.col("i")).alias("in_degree"), zero(F.col("o")).alias("out_degree"), zero(F.col("i") + F.col("o")).alias("total"))


#: Edges of a node whose list of ends is one row of a bucket. The edges of a node with more are rows of a table of their own; there are at most
#: edges / HUB such nodes, whose values are broadcast to it.
HUB = 100_000


def adjacent(edges: DataFrame, end: str, other: str) -> tuple[DataFrame, str, DataFrame | None]:
    """The edges (src, dst, w; parallel ones add up) by one end, for rounds that carry values along them. A table of id, total and to, the list of
    the other ends with their weights, in buckets by id, and its name; and of nodes with over HUB edges a table of id, total, near, w, or None."""
    sizes = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))
    hubs = cut(sizes.where(F.col("n") > HUB).select("id", "total"))
    e = edges.select(F.col(end).alias("id"), F.col(other).alias("near"), "w")
    far = None
    if not hubs.isEmpty():
        far = cut(e.join(F.broadcast(hubs), "id").groupBy("id", "total", "near").agg(F.sum("w").alias("w")))  # at most edges / HUB rows
        e = e.join(F.broadcast(hubs), "id", "left_anti")
    one = e.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").groupBy("id", "near").agg(F.sum("w").alias("w"))
    lists = one.groupBy("id").agg(F.sum("w").alias("total"), F.collect_list(F.struct("near", "w")).alias("to"))
    return *bucketed(lists, ["id"], dealt=True), far


def _carried(values: DataFrame, near: DataFrame, far: DataFrame | None, value: Column) -> DataFrame:
    """id, got: what the edges of adjacent() bring to each node. values: in buckets by id; value: of one edge, from the values' columns, total and w."""
    v = values.join(near, "id").select("*", F.explode("to").alias("edge")).select(*values.columns, "total", F.col("edge.near").alias("near"), F.col("edge.w").alias("w"))
    if far is not None:
        some = values.join(F.broadcast(far.select("id").distinct()), "id", "left_semi")
        v = v.unionByName(far.join(F.broadcast(some), "id").select(*values.columns, "total", "near", "w"))  # both at most edges / HUB rows
    return v.select(F.col("near").alias("id"), value.alias("got")).groupBy("id").agg(F.sum("got").alias("got"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """id, rank. Parallel edges add weight; the rank of nodes without out-edges is spread over all; ranks sum to 1.

    Ends when the ranks move by less than nodes x tolerance in total (None: after all iterations). Edges and ranks are written in
    buckets of the same nodes, so that a round shuffles only what edges bring, summed by bucket.
    """
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    n = max(ids.count(), 1)
    near, name, far = adjacent(edges.select("src", "dst", F.lit(1).alias("w")), "src", "dst")
    leads = near.select("id") if far is None else near.select("id").unionByName(far.select("id").distinct())
    ranks, kept = bucketed(ids.join(leads.withColumn("leads", F.lit(True)), "id", "left").select("id", F.coalesce("leads", F.lit(False)).alias("leads"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("before")), ["id"], dealt=True)
    try:
        lost = F.coalesce(F.sum(F.when(~F.col("leads"), F.col("rank"))), F.lit(0.0))
        ends = ranks.agg(lost).head()[0]
        for _ in range(iterations):
            got = _carried(ranks.where("leads").select("id", "rank"), near, far, F.col("rank") * (F.col("w") / F.col("total")))
            new = F.lit((1 - alpha) / n) + alpha * (F.coalesce("got", F.lit(0.0)) + ends / n)
            old = kept
            ranks, kept = bucketed(ranks.join(got, "id", "left").select("id", "leads", new.alias("rank"), F.col("rank").alias("before")), ["id"], dealt=True)
            unbucketed(spark, old)
            ends, moved = ranks.agg(lost, F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), F.lit(0.0))).head()
            if tolerance is not None and moved < n * tolerance:
                break
        return cut(ranks.select("id", "rank"))
    finally:
        unbucketed(spark, name, kept)


def hits(nodes: DataFrame, edges: DataFrame, iterations: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """id, hub, authority, each summing to 1.

    The edges are written twice in buckets, by either end. A step joins them with values in the same buckets and shuffles only what they
    bring, summed by bucket; what it writes is divided by its sum when it is read. Nodes are numbers on the way; those that nothing
    came to have 0 and no row.
    """
    spark = nodes.sparkSession
    ids = cut(renumbered(nodes.select("id").distinct(), ["id"], 0, "n").select("id", F.col("n").cast("bigint").alias("n")))
    of = lambda end: ids.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"))
    e = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")).join(of("src"), "src").join(of("dst"), "dst")
    e = cut(e.select(F.col("src_n").alias("src"), F.col("dst_n").alias("dst"), "w"))
    ahead, back = adjacent(e, "src", "dst"), adjacent(e, "dst", "src")
    tables = {ahead[1], back[1]}

    def step(values: DataFrame, total: float, by: tuple[DataFrame, str, DataFrame | None]) -> tuple[DataFrame, str, float]:
        near, _, far = by
        came = _carried(values, near, far, F.col("v") / F.lit(total) * F.col("w"))
        out, name = bucketed(came.select("id", F.col("got").alias("v")), ["id"], dealt=True)
        tables.add(name)
        return out, name, out.agg(F.coalesce(F.sum("v"), F.lit(0.0))).head()[0] or 1.0

    def left(*names: str) -> None:
        unbucketed(spark, *names)
        tables.difference_update(names)

    try:
        hub, at = bucketed(ids.select(F.col("n").alias("id"), F.lit(1.0).alias("v")), ["id"])
        tables.add(at)
        sum_h, authority, on = 1.0, None, None
        for _ in range(iterations):
            if on is not None:
                left(on)
            authority, on, sum_a = step(hub, sum_h, ahead)
            new, to, sum_n = step(authority, sum_a, back)
            moved = None
            if tolerance is not None:
                both = new.select("id", (F.col("v") / F.lit(sum_n)).alias("a")).join(hub.select("id", (F.col("v") / F.lit(sum_h)).alias("b")), "id", "full")
                moved = both.agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).head()[0] or 0.0
            left(at)
            hub, at, sum_h = new, to, sum_n
            if tolerance is not None and moved < tolerance:
                break
        own = lambda t, total, name: t.select(F.col("id").alias("n"), (F.col("v") / F.lit(total)).alias(name))
        both = ids.join(own(hub, sum_h, "hub"), "n", "left").join(own(authority, sum_a, "authority"), "n", "left")
        return cut(both.select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("hub", "authority")]))
    finally:
        left(*list(tables))


def triangles(pairs: DataFrame) -> DataFrame:
    """id, triangles, degree in a simple undirected graph (a < b). Edges go from the end of lower degree, so hubs make no large joins.

    The third node of a triangle is a successor of both ends of its first edge: the shorter of their two lists is followed, and the
    other end asked for each node of it. Where few nodes have successors, as the small sides of a graph of layers, little is followed.
    """
    pairs = cut(pairs)  # read for the degrees and for the edges
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    degree = cut(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")))
    da, db = degree.select(F.col("id").alias("a"), F.col("degree").alias("da")), degree.select(F.col("id").alias("b"), F.col("degree").alias("db"))
    first = F.col("da") < F.col("db")
    first = first | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    e = cut(pairs.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    out = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    of = lambda k, n: out.select(F.col("u").alias(k), F.col("n").alias(n))
    both = cut(e.join(of("v", "nv"), "v").join(of("u", "nu"), "u").select("u", "v", (F.col("nv") < F.col("nu")).alias("ahead")))
    ahead = both.where("ahead").join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", "v", "w", F.col("u").alias("x"))
    beside = both.where("not ahead").join(e.select("u", F.col("v").alias("w")), "u").where("v <> w").select("u", "v", "w", F.col("v").alias("x"))
    closed = ahead.unionByName(beside).join(e.select(F.col("u").alias("x"), F.col("v").alias("w")), ["x", "w"])
    t = closed.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return degree.join(t, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"), "degree")


def clustering(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, clustering: closed pairs of neighbours over all; 0 with fewer than 2."""
    t = triangles(pairs)
    value = F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return nodes.select("id").join(t.select("id", value.alias("clustering")), "id", "left").select("id", F.coalesce("clustering", F.lit(0.0)).alias("clustering"))


def together(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """u, root: the smallest node that each other node of the edges (u, v) hangs together with, by alternating large and small stars. keep: writes a frontier and reads it."""
    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # kept, so that the engine can split the rows of a star that are joined to it
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
        edges = keep(pairs.select("p.u", "p.v").where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).head()
        if now == before:
            return edges.select("u", F.col("v").alias("root"))
        before = now


#: Edges whose components a task finds at once.
FOREST = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: the nodes of each FOREST edges (u, v) or so, each with the smallest node that it hangs together with by these edges, if that is another."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ends = pa.chunked_array(t["u"].chunks + t["v"].chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ends.dictionary).to_numpy()
        place = np.empty_like(order)
        place[order] = np.arange(len(order), dtype=order.dtype)
        both = place[ends.indices.to_numpy()].astype(np.int64)
        u, v = both[: len(t)], both[len(t) :]
        root = np.arange(len(order))
        while len(u):  # roots hang on smaller ones, then each node on its root's root until none is above it
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(up := root[root], root):
                root = up
            u, v = root[u], root[v]
            u, v = u[u != v], v[u != v]
        leaves = np.flatnonzero(root != np.arange(len(root)))
        of = lambda x: ends.dictionary.take(pa.array(order[x]))
        return pa.RecordBatch.from_arrays([of(leaves), of(root[leaves])], names=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= FOREST:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that a node hangs together with.

    First tasks replace the edges they read by stars of what hangs together by these. Most stars are whole components if edges of a
    component come together: those whose nodes are in no other. Only the others go through the rounds of `together`.
    """
    ends = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).where("u <> v")
    stars = cut(ends.mapInArrow(_forest, ends.schema))
    leaf = stars.select(F.col("u").alias("id"), F.lit(1).alias("n"), F.lit(0).alias("centre"))
    seen = leaf.unionByName(stars.select(F.col("v").alias("id"), F.lit(0).alias("n"), F.lit(1).alias("centre"))).groupBy("id").agg(F.sum("n").alias("n"), F.max("centre").alias("centre"))
    shared = cut(seen.where("n + centre > 1").select("id"))
    roots = stars
    if not shared.isEmpty():
        unsettled = cut(shared.unionByName(stars.join(shared.withColumnRenamed("id", "u"), "u", "left_semi").select(F.col("v").alias("id"))).distinct().withColumnRenamed("id", "v"))
        rest = together(stars.join(unsettled, "v", "left_semi").select("u", "v"))
        roots = stars.join(unsettled, "v", "left_anti").select("u", "v").unionByName(rest.withColumnRenamed("root", "v"))
    roots = roots.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def modularity(pairs: DataFrame, community: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, modularity: of a weighted simple graph (a, b, weight) and a partition (id, community)."""
    c = community.select("id", "community")
    e = pairs.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inner = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inner"))
    ends = e.select(F.col("ca").alias("community"), "weight").unionByName(e.select(F.col("cb").alias("community"), "weight"))
    total = ends.groupBy("community").agg(F.sum("weight").alias("total"))
    m = total.agg((F.sum("total") / 2).alias("m"))
    each = total.join(inner, "community", "left").join(F.broadcast(m))  # one row
    return each.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("total") / (2 * F.col("m")), 2)).alias("modularity"))


def community_profile(pairs: DataFrame, community: DataFrame) -> DataFrame:
    """community, nodes, edges, density, and its node of highest degree inside with that degree over nodes - 1."""
    c = community.select("id", "community")
    e = pairs.join(c.select(F.col("id").alias("a"), F.col("community")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("community = cb")
    count = e.groupBy("community").agg(F.count(F.lit(1)).alias("edges"))
    inside = e.select("community", F.col("a").alias("id")).unionByName(e.select("community", F.col("b").alias("id"))).groupBy("community", "id").agg(F.count(F.lit(1)).alias("degree"))
    top = inside.groupBy("community").agg(F.max_by("id", F.struct("degree", F.col("id"))).alias("top_id"), F.max("degree").alias("top_degree"))
    n = c.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"))
    out = n.join(count, "community", "left").join(top, "community", "left")
    size = F.col("nodes")
    return out.select("community", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(size > 1, 2.0 * F.coalesce("edges", F.lit(0)) / (size * (size - 1))).otherwise(0.0).alias("density"), "top_id", F.when(size > 1, F.coalesce("top_degree", F.lit(0)) / (size - 1)).otherwise(0.0).alias("top_centrality"))


def eigenvector(pairs: DataFrame, community: DataFrame, iterations: int = 1000, tolerance: float = 1e-6, kernel_edges: int = 200_000) -> DataFrame:
    """id, community, eigenvector: weighted, inside each community; degree centrality where it doesn't settle.

    A community of at most `kernel_edges` links is done in one task; larger ones go together, by a join for each iteration.
    """
    c = community.select("id", "community")
    e = pairs.join(c.select(F.col("id").alias("a"), "community"), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b").where("community = cb").select("community", "a", "b", "weight")
    e = cut(e)
    sizes = e.groupBy("community").agg(F.count(F.lit(1)).alias("links"))
    large = cut(sizes.where(F.col("links") > kernel_edges).select("community"))

    def one(f: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*f["a"], *f["b"]})
        number = {x: i for i, x in enumerate(ids)}
        a, b, w = f["a"].map(number).to_numpy(), f["b"].map(number).to_numpy(), f["weight"].to_numpy(float)
        n, x = len(ids), np.full(len(ids), 1.0 / len(ids))
        for _ in range(iterations):
            y = x + np.bincount(a, w * x[b], n) + np.bincount(b, w * x[a], n)
            y /= np.linalg.norm(y)
            if np.abs(y - x).sum() < n * tolerance:
                break
            x = y
        else:
            y = (np.bincount(a, minlength=n) + np.bincount(b, minlength=n)) / max(n - 1, 1)
        return pd.DataFrame({"id": ids, "community": f["community"].iloc[0], "eigenvector": y})

    done = e.join(large, "community", "left_anti").groupBy("community").applyInPandas(one, "id string, community int, eigenvector double")
    return done if large.isEmpty() else done.unionByName(_eigenvector_joins(e.join(large, "community", "left_semi"), iterations, tolerance))


def _eigenvector_joins(links: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """The same by joins. A community leaves the iteration when it has settled."""
    both = cut(links.select("community", F.col("a").alias("id"), F.col("b").alias("near"), "weight").unionByName(links.select("community", F.col("b").alias("id"), F.col("a").alias("near"), "weight")))
    degree = cut(both.groupBy("community", "id").agg(F.count(F.lit(1)).alias("degree")))
    size = degree.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    x = cut(degree.join(size, "community").select("community", "id", "n", (1.0 / F.col("n")).alias("x")))
    out = None
    for _ in range(iterations):
        came = x.select("community", F.col("id").alias("near"), F.col("x").alias("v")).join(both, ["community", "near"]).groupBy("community", "id").agg(F.sum(F.col("weight") * F.col("v")).alias("came"))
        y = cut(x.join(came, ["community", "id"]).select("community", "id", "n", "x", (F.col("x") + F.col("came")).alias("y")))
        norm = y.groupBy("community").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        y = y.join(norm, "community").select("community", "id", "n", "x", (F.col("y") / F.col("norm")).alias("y"))
        moved = y.groupBy("community", "n").agg(F.sum(F.abs(F.col("y") - F.col("x"))).alias("moved")).select("community", (F.col("moved") < F.col("n") * tolerance).alias("settled"))
        y = cut(y.join(moved, "community"))
        settled = y.where("settled").select("id", "community", F.col("y").alias("eigenvector"))
        out = settled if out is None else out.unionByName(settled)
        x = y.where("not settled").select("community", "id", "n", F.col("y").alias("x"))
        if x.isEmpty():
            return out
    rest = x.join(degree, ["community", "id"]).select("id", "community", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("eigenvector"))
    return rest if out is None else out.unionByName(rest)
