"""Incremental ingestion: model extractions that arrive as files are merged into a graph's tables.

A table is a folder of parts, each named by the first and last batch in it. A batch adds a part with its new edges alone;
compact() puts the parts so far into one. Readers take parts whose write ended and that no wider one holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EDGES = "src string, dst string, type string, properties map<string,string>, ord bigint"


ROWS = "src string, dst string, type string, properties map<string,string>"


def _parts(spark: SparkSession, table: str) -> list[tuple[int, int]]:
    """First and last batch of the parts to read, in order."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(table)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [s.getPath() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    spans = sorted(((int(a), int(b)) for a, b in (x.getName().split("-") for x in done)), key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _read(spark: SparkSession, table: str, parts: list[tuple[int, int]]) -> DataFrame:
    return spark.read.schema(ROWS).parquet(*[f"{table}/{a}-{b}" for a, b in parts]) if parts else spark.createDataFrame([], ROWS)


def merge_edges(spark: SparkSession, incoming: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New edges (JSON files) are added to a table, insert only. A batch that is run again after a failure writes its own part again."""

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        before = _read(s, table, [x for x in _parts(s, table) if x[1] < number])
        fresh = batch.join(before, ["src", "dst", "type"], "left_anti").groupBy("src", "dst", "type").agg(F.min_by("properties", "ord").alias("properties"))
        fresh.write.mode("overwrite").parquet(f"{table}/{number}-{number}")

    stream = spark.readStream.schema(EDGES).json(incoming)
    out = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def compact(spark: SparkSession, table: str) -> None:
    """All parts so far as one; then those go. Not while a batch runs."""
    parts = _parts(spark, table)
    if len(parts) < 2:
        return
    _read(spark, table, parts).write.mode("overwrite").parquet(f"{table}/{parts[0][0]}-{parts[-1][1]}")
    jvm = spark.sparkContext._jvm
    for a, b in parts:
        p = jvm.org.apache.hadoop.fs.Path(f"{table}/{a}-{b}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The table as of the last batch whose write ended."""
    return _read(spark, table, _parts(spark, table))


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by window and type; what is later than `late` is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
