"""Writing names, records, graphs, import scripts, questions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.operators.graph import PropertyGraph


def names(rows: DataFrame, path: str) -> None:
    """Sorted lines, in files that follow each other."""
    rows.distinct().orderBy("value").write.mode("overwrite").text(path)


def records(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def metadata(graph: PropertyGraph) -> DataFrame:
    """One row: totals and types of nodes and edges."""
    n = graph.nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total_nodes"), F.array_sort(F.collect_list("type")).alias("node_types"))
    e = graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("total_edges"), F.array_sort(F.collect_list("type")).alias("edge_types"))
    return n.join(e)  # one row each


def graph_tables(graph: PropertyGraph, path: str) -> None:
    """nodes and edges as Parquet, by type, and their metadata."""
    graph.nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    metadata(graph).write.mode("overwrite").json(f"{path}/metadata")


#: Nodes and edges up to which a graph may be written as one document.
DOCUMENT_ROWS = 2_000_000


def graph_document(graph: PropertyGraph, path: str) -> None:
    """The whole graph as one JSON document, in the form that readers.graph_document takes; refused beyond DOCUMENT_ROWS rows, as one task writes it."""
    if graph.nodes.limit(DOCUMENT_ROWS + 1).count() + graph.edges.limit(DOCUMENT_ROWS + 1).count() > DOCUMENT_ROWS:
        raise ValueError(f"a document takes at most {DOCUMENT_ROWS} nodes and edges; write tables")
    n = graph.nodes.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("id", "type", "name", F.map_entries("properties").alias("p")))).alias("xs"))
    n = n.agg(F.map_from_entries(F.collect_list(F.struct("type", F.transform("xs", lambda x: F.struct(x["id"], x["type"], x["name"], F.map_from_entries(x["p"]).alias("properties"))).alias("xs")))).alias("nodes"))
    order = "ord" if "ord" in graph.edges.columns else "src"
    e = graph.edges.groupBy("type").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "src", "dst", "type", F.map_entries("properties").alias("p")))).alias("xs"))
    e = e.agg(F.map_from_entries(F.collect_list(F.struct("type", F.transform("xs", lambda x: F.struct(x["src"].alias("from"), x["dst"].alias("to"), x["type"], F.map_from_entries(x["p"]).alias("properties"))).alias("xs")))).alias("edges"))
    m = metadata(graph).select(F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "total_nodes", "total_edges", "node_types", "edge_types").alias("metadata"))
    m.join(n).join(e).coalesce(1).write.mode("overwrite").json(path)  # one row each


def truncated(graph_path: str, like: PropertyGraph) -> None:
    """Empties a written graph; its tables keep their columns."""
    graph_tables(PropertyGraph(like.nodes.limit(0), like.edges.limit(0)), graph_path)


def replace_edges(edges: DataFrame, path: str) -> None:
    """The edge types in `edges` replace those in a written graph; other types stay."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("type").parquet(f"{path}/edges")


def exported(graph: PropertyGraph) -> PropertyGraph:
    """Nodes and edges of the declared types, without provenance."""
    keep = lambda deny: F.map_filter("properties", lambda k, _: ~k.isin(deny))
    return PropertyGraph(
        graph.nodes.where(F.col("type").isin(*C.LABEL_PREFIX)).withColumn("properties", keep(C.NODE_DENY)),
        graph.edges.where(F.col("type").isin(*C.EDGE_TYPES)).withColumn("properties", keep(C.EDGE_DENY)),
    )


def graph_lines(graph: PropertyGraph) -> DataFrame:
    """part, type, json: every node and edge as one JSON line; properties are left out where there are none."""
    props = F.when(F.size("properties") > 0, F.col("properties"))
    n = graph.nodes.select(F.lit("nodes").alias("part"), "type", F.to_json(F.struct("id", "type", "name", props.alias("properties"))).alias("json"))
    e = graph.edges.select(F.lit("edges").alias("part"), "type", F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "type", props.alias("properties"))).alias("json"))
    return n.unionByName(e)


def _quoted(x: Column) -> Column:
    return F.to_json(F.struct(x.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("v")))) - 6)


def _pairs(m: Column) -> Column:
    kept = F.filter(F.map_entries(m), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e["key"], F.lit(": "), _quoted(e["value"]))), ", ")


def import_script(graph: PropertyGraph, constraints: bool = True) -> DataFrame:
    """ord, line: statements that make constraints, nodes and edges; properties of edges only where their type has them, empty ones left out."""
    spark = graph.nodes.sparkSession
    heads = [(0, i, f"CREATE CONSTRAINT {label.lower()}_id IF NOT EXISTS FOR (n:{label}) REQUIRE n.id IS UNIQUE;") for i, label in enumerate(C.LABEL_PREFIX)] if constraints else []
    head = spark.createDataFrame(heads, "ord int, at int, line string")
    rank = lambda names: F.array_position(F.array(*[F.lit(x) for x in names]), F.col("type")).cast("int")
    own = F.concat(F.lit("id: "), _quoted(F.col("id")), F.lit(", name: "), _quoted(F.col("name")))
    extra = _pairs(F.coalesce("properties", F.expr("cast(map() as map<string,string>)")))
    node = graph.nodes.where(F.col("type").isin(*C.LABEL_PREFIX)).select(F.lit(1).alias("ord"), rank(C.LABEL_PREFIX).alias("at"), F.concat(F.lit("MERGE (n:"), "type", F.lit(" {"), F.concat_ws(", ", own, F.nullif(extra, F.lit(""))), F.lit("});")).alias("line"))
    kinds = spark.createDataFrame([(k, v[0], v[1], v[3]) for k, v in C.EDGE_TYPES.items()], "type string, a string, b string, shown boolean")  # the declared types
    e = graph.edges.join(F.broadcast(kinds), "type")
    text = F.when(F.col("shown"), F.nullif(_pairs(F.coalesce("properties", F.expr("cast(map() as map<string,string>)"))), F.lit("")))
    line = F.concat(F.lit("MATCH (a:"), "a", F.lit(" {id: "), _quoted(F.col("src")), F.lit("}), (b:"), "b", F.lit(" {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), "type", F.coalesce(F.concat(F.lit(" {"), text, F.lit("}")), F.lit("")), F.lit("]->(b);"))
    return head.unionByName(node).unionByName(e.select(F.lit(2).alias("ord"), rank(C.EDGE_TYPES).alias("at"), line.alias("line")))


def script(lines: DataFrame, path: str) -> None:
    lines.orderBy("ord", "at", "line").select("line").write.mode("overwrite").text(path)


def communities(members: DataFrame, path: str) -> None:
    """A CSV folder for each community: Name, ID, Birth Year, by name. members: community, name, id, birth_year."""
    rows = members.select("community", F.col("name").alias("Name"), F.col("id").alias("ID"), F.coalesce(F.col("birth_year").cast("string"), F.lit("")).alias("Birth Year"))
    rows.repartition("community").sortWithinPartitions("community", "Name", "ID").write.mode("overwrite").partitionBy("community").csv(path, header=True)


def questions(rows: DataFrame, path: str) -> None:
    """Questions and answers as CSV, by type, numbered from 1 in each; true and false get their labels. rows: q_type, question, hop_count, reasoning_path, variant_type, answer."""
    from tessera.operators.questions import ranked

    label = F.when(F.col("answer") == "True", C.TRUE_LABEL).when(F.col("answer") == "False", C.FALSE_LABEL).otherwise(F.col("answer"))
    numbered = ranked(rows, ["q_type"], ["question", "reasoning_path"], "id").withColumns({"id": F.col("id") + 1, "answer": label})
    for name, columns in (("questions", ["id", "question", "hop_count", "reasoning_path", "variant_type"]), ("answers", ["id", "answer"])):
        numbered.select("q_type", *columns).write.mode("overwrite").partitionBy("q_type").csv(f"{path}/{name}", header=True, escape='"')


def append(rows: DataFrame, path: str, kind: str = "json") -> None:
    rows.write.mode("append").format(kind).save(path)


def report(sections: dict[str, DataFrame], top: int = 10) -> str:
    """A text report: the first rows of each section."""
    out = []
    for title, frame in sections.items():
        out += [title, "-" * len(title)]
        out += ["  " + ", ".join(f"{k}: {v}" for k, v in r.asDict().items()) for r in frame.limit(top).collect()]
        out.append("")
    return "\n".join(out)


def rankings(rows: DataFrame, graph: PropertyGraph, path: str) -> None:
    """A ranking document: metadata and, for each measure and kind of node, the best ones in order. rows: profiles.rankings."""
    item = F.struct("rank", "id", "name", "type", "score")
    lists = rows.groupBy("measure", "of").agg(F.array_sort(F.collect_list(item)).alias("best"))
    by = lists.groupBy("measure").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("of", "best")))).alias("lists"))
    doc = by.agg(F.map_from_entries(F.collect_list(F.struct("measure", "lists"))).alias("rankings"), F.array_sort(F.collect_list("measure")).alias("algorithms"))
    m = metadata(graph).select("total_nodes", "total_edges", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    both = m.join(doc)  # one row each
    both.select(F.struct("timestamp", "total_nodes", "total_edges", "algorithms").alias("metadata"), "rankings").coalesce(1).write.mode("overwrite").json(path)


def text_report(spark, text: str, path: str) -> None:
    """A report as one text file in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def evaluation(results: DataFrame, path: str) -> None:
    """An evaluation's files: results and statistics as JSON lines by q_type, and the metrics as text. results: evaluation.statistics, with more columns."""
    from tessera.operators.evaluation import statistics, summary

    results.write.mode("overwrite").partitionBy("q_type").json(f"{path}/results")
    statistics(results).coalesce(1).write.mode("overwrite").partitionBy("q_type").json(f"{path}/statistics")  # a row for each type
    text_report(results.sparkSession, summary(results), f"{path}/metrics")
