"""Paths in property graphs. Each step is one join of a frontier with the edges; paths ride along as arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import cut, drop


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in either direction, with its own edge_id."""
    e = edges.select("edge_id", "src", "dst", "type")
    return e.unionByName(e.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))


def is_simple(nodes: Column) -> Column:
    return F.size(F.array_distinct(nodes)) == F.size(nodes)


def capped(edges: DataFrame, most: int) -> DataFrame:
    """At most so many out-edges of each node, by edge_id: a parameter of the question generators, not a guard."""
    n = F.row_number().over(Window.partitionBy("src").orderBy("edge_id"))
    return edges.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def k_hop(edges: DataFrame, k: int) -> DataFrame:
    """All simple directed paths of k edges: path [node, type, node, …]."""
    e = edges.select("src", "dst", "type")
    out = e.where("src <> dst").select("src", "dst", F.array("src", "type", "dst").alias("path"))
    for _ in range(1, k):
        step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"), "type")
        out = out.join(step, "dst").where(~F.array_contains(F.filter("path", lambda _, i: i % 2 == 0), F.col("next")))
        out = out.select("src", F.col("next").alias("dst"), F.concat("path", F.array("type", "next")).alias("path"))
    return out


def explore(starts: DataFrame, edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """From starts (id), one or two edges in any direction to allowed nodes (id); no edge twice. start, relations, nodes."""
    both = both_ways(edges)
    one = starts.select(F.col("id").alias("start")).join(both, F.col("start") == both["src"]).select("start", "dst", F.array("edge_id").alias("edges"), F.array("type").alias("relations"), F.array("start", "dst").alias("nodes"))
    more = both.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("edge_id").alias("e2"), F.col("type").alias("t2"))
    two = one.join(more, "dst").where(~F.array_contains("edges", F.col("e2"))).select("start", F.col("next").alias("dst"), F.concat("edges", F.array("e2")).alias("edges"), F.concat("relations", F.array("t2")).alias("relations"), F.concat("nodes", F.array("next")).alias("nodes"))
    return one.unionByName(two).join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi").select("start", "relations", "nodes")


def shortest(starts: DataFrame, ends: DataFrame, edges: DataFrame, longest: int, directed: bool = True) -> DataFrame:
    """For each start (id) and end (id) that it reaches in at most `longest` edges, the least of its shortest paths in array order. start, end, length, path.

    A level keeps one path for each (start, node), so a level holds no more rows than starts times nodes reached; and only nodes
    from which an end is so near that the path can still be short enough: how near the nearest is, is searched first, from all ends together.
    """
    e = cut((edges.select("src", "dst", "type") if directed else both_ways(edges).select("src", "dst", "type")).groupBy("src", "dst").agg(F.min("type").alias("type")))
    near = front = cut(ends.select(F.col("id").alias("dst")).distinct().withColumn("left", F.lit(0)))
    for left in range(1, longest):
        front = cut(e.join(front.select("dst"), "dst", "left_semi").select(F.col("src").alias("dst")).distinct().join(near, "dst", "left_anti").withColumn("left", F.lit(left)))
        near = near.unionByName(front)
    e = cut(e.join(near, "dst"))
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    seen, found = level.select("start", "node"), []
    for length in range(1, longest + 1):
        step = level.join(e.where(F.col("left") <= longest - length), level["node"] == e["src"]).select("start", F.col("dst").alias("node"), F.concat("path", F.array("type", "dst")).alias("path"))
        level = cut(step.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path")))
        seen = seen.unionByName(level.select("start", "node"))
        found.append(level.join(ends.select(F.col("id").alias("node")), "node", "left_semi").select("start", F.col("node").alias("end"), F.lit(length).alias("length"), "path"))
        if level.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def between(pairs: DataFrame, edges: DataFrame, longest: int, directed: bool = True) -> DataFrame:
    """For each pair (start, end) the least of its shortest paths of at most `longest` edges in array order, as `shortest` has it. start, end, length, path.

    Two searches meet, one from each start for all its pairs together, one for each pair against the edges from its end. In a round the side of a
    start grows by one edge, or those of its pairs, from whose nodes fewer edges are to be followed in all (of equal ones the start);
    where the two sides meet the pair is found and leaves. So a round has rows of pairs that are still open alone, and no hub is
    opened while the other side has less to do. Of each side a node keeps the least path, as least parts make the least whole. The last round
    only looks for the other side. Cases: a pair of one node twice has no path; pairs that come more than once are one; null ends lead nowhere.
    """
    e = cut((edges.select("src", "dst", "type") if directed else both_ways(edges).select("src", "dst", "type")).groupBy("src", "dst").agg(F.min("type").alias("type")))
    pair = ["start", "end"]
    p = cut(pairs.select(*pair).where("start <> end").distinct())
    away, into = (cut(e.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias("ways"))) for c in ("src", "dst"))
    led = lambda rows, ways: rows.join(ways, "node")  # noqa: E731  a node without edges leads nowhere; it may still be met
    on, back = e.select(F.col("src").alias("node"), F.col("dst").alias("to"), "type"), e.select(F.col("dst").alias("node"), F.col("src").alias("to"), "type")
    front = cut(p.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    behind = cut(p.select(*pair, F.col("end").alias("node"), F.array("end").alias("path")))
    seen, seen_behind, found, old = front.select("start", "node"), behind.select(*pair, "node"), [], []
    for length in range(1, longest + 1):
        open_ = led(behind.select(*pair, "node"), into).groupBy(*pair).agg(F.sum("ways").alias("b"))
        size = led(front.select("start", "node"), away).groupBy("start").agg(F.sum("ways").alias("f"))
        live = cut(open_.groupBy("start").agg(F.sum("b").alias("b")).join(size, "start").select("start", (F.col("f") <= F.col("b")).alias("forth")))
        one, other = live.where("forth").select("start"), live.where("not forth").select("start")
        ahead = front.join(one, "start", "left_semi").join(on, "node").select("start", F.col("to").alias("node"), F.concat("path", F.array("type", "to")).alias("path"))
        before = behind.join(other, "start", "left_semi").join(back, "node").select(*pair, F.col("to").alias("node"), F.concat(F.array("to", "type"), F.col("path")).alias("path"))
        last = length == longest
        if not last:
            ahead = cut(ahead.join(seen, ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path")))
            before = cut(before.join(seen_behind, [*pair, "node"], "left_anti").groupBy(*pair, "node").agg(F.min("path").alias("path")))
        first, rest = F.col("path"), F.slice("rest", F.lit(2), F.size("rest"))
        met = ahead.join(behind.withColumnRenamed("path", "rest"), ["start", "node"]).select(*pair, F.concat(first, rest).alias("path"))
        met = met.unionByName(front.join(before.withColumnRenamed("path", "rest"), ["start", "node"]).select(*pair, F.concat(first, rest).alias("path")))
        met = cut(met.groupBy(*pair).agg(F.min("path").alias("path")))
        found.append(met.select(*pair, F.lit(length).alias("length"), "path"))
        if last or live.isEmpty():
            break
        seen, seen_behind = seen.unionByName(ahead.select("start", "node")), seen_behind.unionByName(before.select(*pair, "node"))
        still = behind.join(one, "start", "left_semi").unionByName(before).join(met.select(*pair), pair, "left_anti")
        next_behind = cut(still)
        stay = front.join(other, "start", "left_semi").unionByName(ahead).join(next_behind.select("start").distinct(), "start", "left_semi")
        next_front = cut(stay)
        drop(*old, live)  # what is seen is in the first tables and the new ones of each round
        old = [next_front, next_behind]
        front, behind = next_front, next_behind
    return reduce(DataFrame.unionByName, found) if found else p.select(*pair, F.lit(0).alias("length"), F.array("start").alias("path")).limit(0)


def simple_paths(starts: DataFrame, ends: DataFrame, edges: DataFrame, least: int, longest: int) -> DataFrame:
    """All simple directed paths of least to longest edges. start, end, length, path."""
    e = edges.select("src", "dst", "type")
    level = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("path"))
    found = None
    for length in range(1, longest + 1):
        step = level.join(e, level["node"] == e["src"]).where(~F.array_contains("path", F.col("dst")))
        level = step.select("start", F.col("dst").alias("node"), F.concat("path", F.array("type", "dst")).alias("path"))
        if length >= least:
            here = level.join(ends.select(F.col("id").alias("node")), "node", "left_semi").select("start", F.col("node").alias("end"), F.lit(length).alias("length"), "path")
            found = here if found is None else found.unionByName(here)
    return found


def verify(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, valid: whether a path has an odd length of 3 or more and all its nodes and typed edges exist. paths: id, path."""
    n, e = nodes.select(F.col("id").alias("x")).distinct(), edges.select("src", "type", "dst").distinct()
    shaped = F.coalesce((F.size("path") % 2 == 1) & (F.size("path") >= 3), F.lit(False))
    node = paths.where(shaped).select("id", F.posexplode("path").alias("pos", "x")).where("pos % 2 = 0")
    lost = node.join(n, "x", "left_anti").select("id")
    hop = paths.where(shaped).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 2, F.lit(2)), lambda i: F.struct(F.get("path", i - 1).alias("src"), F.get("path", i).alias("type"), F.get("path", i + 1).alias("dst")))).alias("h")).select("id", "h.*")
    bad = lost.unionByName(hop.join(e, ["src", "type", "dst"], "left_anti").select("id")).distinct().withColumn("bad", F.lit(True))
    return paths.select("id", shaped.alias("shaped")).join(bad, "id", "left").select("id", (F.col("shaped") & F.col("bad").isNull()).alias("valid"))


def answers(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, answer: the name of each path's last node."""
    last = paths.select("id", F.element_at("path", -1).alias("node"))
    return last.join(nodes.select(F.col("id").alias("node"), F.col("name").alias("answer")), "node").select("id", "answer")


def facts(claims: DataFrame, graph_names: DataFrame) -> DataFrame:
    """claims (id, subject, type, object) with holds: whether some nodes of these names have such an edge. graph_names: src_key, type, dst_key."""
    known = graph_names.select(F.col("src_key").alias("subject_key"), "type", F.col("dst_key").alias("object_key")).distinct().withColumn("holds", F.lit(True))
    keyed = claims.withColumns({"subject_key": F.lower(F.trim("subject")), "object_key": F.lower(F.trim("object"))})
    return keyed.join(known, ["subject_key", "type", "object_key"], "left").select("id", F.coalesce("holds", F.lit(False)).alias("holds"))


def chain(starts: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """Paths from starts (id) along edges of the given types, in this order. start, end, path."""
    out = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("path"))
    for t in types:
        step = edges.where(F.col("type") == t).select(F.col("src").alias("end"), F.col("dst").alias("next"))
        out = out.join(step, "end").select("start", F.col("next").alias("end"), F.concat("path", F.array(F.lit(t), F.col("next"))).alias("path"))
    return out


def sample(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """n nodes by the order of a seeded hash."""
    return nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)
