"""Pattern queries: who has which relation to what. Names match where one contains the other, whatever the case; limits come after a total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import contains_ci
from tessera.operators import paths
from tessera.operators.graph import PropertyGraph, named
from tessera.operators.names import contained


@dataclass(frozen=True)
class Pattern:
    """A relation, the columns that it returns, what it is ordered by, and how many rows: both ends given, the source, the target."""

    edge: str
    target: str
    properties: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    limits: tuple[int, int, int] = (20, 20, 50)
    source: str = "Politician"
    as_source: str = "name"
    as_target: str = "target"
    inward: bool = False
    distinct: bool = False


#: The relations of the biographical graph and how many rows their queries return.
PATTERNS = {
    "BORN_AT": Pattern("BORN_AT", "Location", limits=(5, 5, 20), as_target="birth_place"),
    "DIED_AT": Pattern("DIED_AT", "Location", limits=(20, 5, 20), as_target="death_place"),
    "PRECEDED": Pattern("PRECEDED", "Politician", limits=(20, 20, 20), as_target="predecessor", distinct=True),
    "SUCCEEDED": Pattern("SUCCEEDED", "Politician", limits=(20, 20, 20), as_target="successor", inward=True, distinct=True),
    "SERVED_AS": Pattern("SERVED_AS", "Position", ("term_start", "term_end", "status", "reason"), ("term_start",), (50, 20, 50), as_target="position"),
    "HAS_RANK": Pattern("HAS_RANK", "MilitaryRank", as_target="rank"),
    "ALUMNUS_OF": Pattern("ALUMNUS_OF", "AlmaMater", as_target="school"),
    "AWARDED": Pattern("AWARDED", "Award", limits=(50, 20, 50), as_target="award"),
    "SERVED_IN": Pattern("SERVED_IN", "MilitaryCareer", ("year_start", "year_end"), as_target="career"),
    "FOUGHT_IN": Pattern("FOUGHT_IN", "Campaigns", as_target="campaign"),
    "HAS_ACADEMIC_TITLE": Pattern("HAS_ACADEMIC_TITLE", "AcademicTitle", as_target="title"),
}
EXPLORED = ("Position", "Location", "AlmaMater", "Award", "Politician")


def one_hop(graph: PropertyGraph, p: Pattern, source: str | None = None, target: str | None = None, position: str | None = None, limited: bool = True) -> DataFrame | None:
    """The pattern's rows for a source name, a target name or both; None without either. position: the name of a succession's office."""
    if source is None and target is None:
        return None
    e = graph.edges.where(F.col("type") == p.edge)
    if p.inward:
        e = e.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    rows = named(graph, e).where((F.col("src_type") == p.source) & (F.col("dst_type") == p.target))
    if source is not None:
        rows = rows.where(contains_ci(F.col("src_name"), source))
    if target is not None:
        rows = rows.where(contains_ci(F.col("dst_name"), target))
    if position is not None:
        office = graph.nodes.where(contains_ci(F.col("name"), position)).select(F.col("id").alias("_office"))
        rows = rows.join(office, F.col("properties")["position_id"] == F.col("_office"), "left_semi")
    props = [F.nullif(F.col("properties")[k], F.lit("")).alias(k) for k in p.properties]
    out = rows.select(F.col("src_name").alias(p.as_source), F.col("dst_name").alias(p.as_target), *props)
    if p.distinct:
        out = out.distinct()
    first = [F.col(k).asc_nulls_last() for k in p.order]
    out = out.orderBy(*first, *[F.col(c).asc_nulls_last() for c in out.columns if c not in p.order])
    return out.limit(p.limits[0 if source is not None and target is not None else 1 if source is not None else 2]) if limited else out


def from_intent(graph: PropertyGraph, intent: str, entities: list[dict[str, str]], patterns: dict[str, Pattern] | None = None) -> DataFrame | None:
    """The intent's query for the first entity of each type; None for unknown intents or without entities."""
    p = (patterns or PATTERNS).get(intent)
    if p is None:
        return None
    first: dict[str, str] = {}
    for e in entities:
        first.setdefault(e["type"], e["text"])
    if p.source == p.target:
        return one_hop(graph, p, first.get(p.source), position=first.get("Position"))
    return one_hop(graph, p, first.get(p.source), first.get(p.target))


def with_ids(graph: PropertyGraph) -> DataFrame:
    """Edges with an id: their order if they have one, else a hash of what they are."""
    e = graph.edges
    return e if "edge_id" in e.columns else e.withColumn("edge_id", F.xxhash64("src", "type", "dst", F.to_json("properties")))


def exploration(graph: PropertyGraph, names: list[str], limit: int = 20, explored: list[str] = (), labels: tuple[str, ...] = EXPLORED, source: str = "Politician") -> DataFrame | None:
    """One or two edges around the sources that match a name: source_entity, relations, node names."""
    if not names:
        return None
    match = F.lit(False)
    for n in names:
        match = match | contains_ci(F.col("name"), n)
    starts = graph.nodes.where((F.col("type") == source) & match).select("id")
    allowed = graph.nodes.where(F.col("type").isin(*labels) & ~F.col("name").isin(*explored, "")).select("id")
    rows = paths.explore(starts, with_ids(graph), allowed)
    return with_names(rows, graph.nodes).orderBy(F.size("relations"), "source_entity", "relations", "node_names").limit(limit)


def with_names(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_entity, relations, node_names of rows (start, relations, nodes)."""
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    each = keyed.select("_row", "relations", F.posexplode("nodes").alias("pos", "id")).join(nodes.select("id", "name"), "id")
    one = each.groupBy("_row", "relations").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("node_names"))
    return one.select(F.col("node_names")[0].alias("source_entity"), "relations", "node_names")


def path_query(graph: PropertyGraph, start: str, end: str, depth: int = 4, limit: int = 5, labels: tuple[str, ...] = ("Politician", "Position", "Location", "AlmaMater"), source: str = "Politician") -> DataFrame:
    """Shortest undirected paths from sources of one name to nodes of another."""
    s = graph.nodes.where((F.col("type") == source) & contains_ci(F.col("name"), start)).select("id")
    t = graph.nodes.where(F.col("type").isin(*labels) & contains_ci(F.col("name"), end)).select("id")
    return paths.shortest(s, t, with_ids(graph), depth, directed=False).where("start <> end").orderBy("length", "start", "end").limit(limit)


def chain_query(graph: PropertyGraph, start: str, types: list[str], limit: int = 20, source: str = "Politician") -> DataFrame:
    s = graph.nodes.where((F.col("type") == source) & contains_ci(F.col("name"), start)).select("id")
    return paths.chain(s, graph.edges, types).orderBy("path").limit(limit)


def per_entity(graph: PropertyGraph, edge: str, names: list[str] | None = None) -> DataFrame:
    """name, n and targets: how many targets each source name has by one relation, and which. Names given stay even without any."""
    rows = named(graph, graph.edges.where(F.col("type") == edge)).select(F.col("src_name").alias("name"), F.col("dst_name").alias("target"))
    if names is not None:
        match = F.lit(False)
        for n in names:
            match = match | contains_ci(F.col("name"), n)
        rows = graph.nodes.where(match).select("name").distinct().join(rows, "name", "left")
    return rows.groupBy("name").agg(F.count("target").alias("n"), F.array_sort(F.collect_list("target")).alias("targets"))


def aggregation(graph: PropertyGraph, edge: str, limit: int = 10) -> DataFrame:
    return per_entity(graph, edge).orderBy(F.desc("n"), "name").limit(limit)


def comparison(graph: PropertyGraph, edge: str, names: list[str]) -> DataFrame | None:
    """None for fewer than two names."""
    return per_entity(graph, edge, names).orderBy(F.desc("n"), "name") if len(names) > 1 else None


def compared(graph: PropertyGraph, names: list[str], attribute: str, edge: str | None = None, source: str = "Politician") -> DataFrame | None:
    """The sources that match two or more names by one of their properties: name, the attribute under its name, and with a relation
    their total of it and items, most first; without one in the attribute's order, missing ones last. None for fewer than two names.

    A row is a node, so that two of one name stay two.
    """
    if len(names) < 2:
        return None
    match = F.lit(False)
    for n in names:
        match = match | contains_ci(F.col("name"), n)
    rows = graph.nodes.where((F.col("type") == source) & match).select("id", "name", F.try_element_at("properties", F.lit(attribute)).alias(attribute))
    if edge is None:
        return rows.orderBy(F.col(attribute).asc_nulls_last(), "name", "id").drop("id")
    to = graph.edges.where(F.col("type") == edge).select(F.col("src").alias("id"), "dst").join(rows.select("id"), "id", "left_semi")
    named_to = to.join(graph.nodes.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst")
    per = named_to.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("target")).alias("got"))
    none = F.expr("cast(array() as array<string>)")
    return rows.join(per, "id", "left").select("id", "name", attribute, F.coalesce("n", F.lit(0)).alias("total"), F.coalesce("got", none).alias("items")).orderBy(F.desc("total"), "name", "id").drop("id")


#: The columns that name entities in earlier results.
ENTITY_KEYS = ("name", "politician", "source_entity", "predecessor", "successor")


def harvested(previous: DataFrame, known: list[str], most: int = 5) -> list[str]:
    """Up to `most` names in an earlier result of at most a few dozen rows, without those known."""
    seen: dict[str, None] = {}
    for row in previous.collect():
        for k in ENTITY_KEYS:
            v = row[k] if k in row else None
            if v and len(v) > 2 and v not in known:
                seen.setdefault(v)
    return list(seen)[:most]


def exists(graph: PropertyGraph, label: str, name: str) -> DataFrame:
    return graph.nodes.where((F.col("type") == label) & (F.lower("name") == F.lower(F.lit(name)))).orderBy("id").limit(1)


def any_persons(graph: PropertyGraph, source: str = "Politician", limit: int = 5) -> DataFrame:
    return graph.nodes.where(F.col("type") == source).orderBy("id").limit(limit)


def column_search(frame: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """Rows whose column contains a word, in any case, with the word."""
    pairs = contained(frame.select(F.col(column).alias("text")), words.select(F.col("word").alias("part")))
    return frame.join(pairs.select(F.col("text").alias(column), F.col("part").alias("word")), column)

