"""Secrets in texts, by a ledger of content-addressed blobs.

A text is a blob, addressed by its SHA-256; the rules together are a version, addressed by theirs. The ledger has the
findings of each (blob, rules) that was ever scanned. A scan reads the texts of those pairs alone that the ledger lacks,
one text for each blob, and then joins findings back to every path (row) that holds the blob.

Which rows hold a text to be scanned is decided on addresses. Two bitmaps of bounded size keep text from being shuffled:
rows that surely stand for no new blob go, rows whose blob surely has one row and is new are scanned where they are read;
what both bitmaps leave open is joined by address to the rows that stand for their blobs. With more blobs than the bitmaps
can tell apart more rows take that join, and the result is the same.

Cases: a null text is the empty one; a null path is a path; rows that repeat a path and text are reported each, and
may be scanned each; other columns are not looked at, whatever they are called; a very long text is scanned whole;
empty tables give empty results. Spans that start at one place are ordered by their kinds' order here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, sieve, table, written

#: Kinds, their patterns, the group whose length counts, and the least length. The first three are the base.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("login", r"[a-z]+://[A-Za-z0-9._-]+:[^\x00-\x20/@:]+@", 0, 12),
    ("hosted", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
BASE = ("assign", "access", "hex")
#: What a text has at least, in any case, if a kind is in it.
_HINTS = {"assign": r"(?i)pass|secret|token|api_?key", "access": "AKIA", "key": "PRIVATE KEY-----", "jwt": "eyJ", "login": "://", "hosted": "gh[pousr]_"}

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def version(rules: tuple = RULES) -> str:
    """The rules' address."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def _compiled(rules: tuple) -> list[tuple[str, re.Pattern, int, int]]:
    out = []
    for kind, pattern, group, least in rules:
        if kind == "hex" and pattern.endswith("]+"):
            pattern = f"{pattern[:-1]}{{{least},}}"  # the same: a run is matched from its start to its end, or not
        out.append((kind, re.compile(pattern.encode()), group, least))
    return out


def _spans(text: bytes, rules: list[tuple[str, re.Pattern, int, int]], wanted: list[bool]) -> list[dict]:
    """The matches of each kind that are long enough, leftmost and without overlap, as code points; by start, then kind."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        if wanted[k]:
            found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if not found:
        return []
    found.sort()
    if not text.isascii():
        places = sorted({x for f in found for x in (f[0], f[2])})
        code, at, n = {}, 0, 0
        for p in places:
            n, at = n + len(text[at:p].decode()), p
            code[p] = n
        found = [(code[a], k, code[b], kind) for a, k, b, kind in found]
    return [{"kind": kind, "start": a, "end": b} for a, _, b, kind in found]


def _scanned(texts: pa.Array, rules: list[tuple[str, re.Pattern, int, int]]) -> list[list[dict]]:
    """The spans of each text (no null)."""
    n = len(texts)
    hints = [pc.match_substring_regex(texts, _HINTS[kind]).to_pylist() if kind in _HINTS else [True] * n for kind, *_ in rules]
    return [_spans(t.as_py(), rules, list(w)) for t, w in zip(texts.cast(pa.large_binary()), zip(*hints, strict=True), strict=True)]


def address(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class Ledger:
    """Findings of every (blob, rules) that was scanned, in a folder that all executors share."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path

    def of(self, rules: str) -> DataFrame:
        """blob, spans: what was scanned by these rules."""
        schema = f"blob binary, spans {SPANS}"
        if self.path is not None:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rules={rules}")
            if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                return self.spark.read.schema(schema).parquet(at.toString())
        return self.spark.createDataFrame([], schema)

    def add(self, rules: str, found: DataFrame) -> None:
        """Append what was scanned now. A run that is repeated after a failure finds it here and adds nothing twice."""
        if self.path is not None:
            found.write.mode("append").parquet(f"{self.path}/rules={rules}")


def _may_hold(by: tuple[object, int], hashes: pa.Array) -> np.ndarray:
    bits, n_bits = by[0].value, by[1]
    at = hashes.to_numpy(zero_copy_only=False) & (n_bits - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def unseen(versions: DataFrame, known: DataFrame) -> DataFrame:
    """blob, rows, first: blobs of versions (path, blob) that aren't known, how many rows have each, and the path of the row that stands for it."""
    return versions.groupBy("blob").agg(F.count(F.lit(1)).alias("rows"), F.min("path").alias("first")).join(known.select("blob"), "blob", "left_anti")


def scan_new(docs: DataFrame, path: Column, versions: DataFrame, known: DataFrame, rules: tuple = RULES) -> DataFrame:
    """blob, spans of the blobs of docs (text) that aren't known. versions: the path and blob of each row of docs, written."""
    new = written(unseen(versions, known), "new-blobs")
    stands = sieve(new.select(F.xxhash64("blob", "first").alias("h")), "h")
    alone = new.where("rows = 1").select("blob")
    shared = sieve(versions.select("blob").distinct().join(alone, "blob", "left_anti").select(F.xxhash64("blob").alias("h")), "h")
    rows = docs.select(address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"), path.alias("path"))
    rows = rows.select("blob", "text", F.xxhash64("blob", "path").alias("row_hash"), F.xxhash64("blob").alias("blob_hash"), "path")
    out = f"blob binary, spans {SPANS}, text string, path {rows.schema['path'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(rules)
        for b in batches:
            b = b.filter(pa.array(_may_hold(stands, b.column(2))))
            several = pa.array(_may_hold(shared, b.column(3)))
            sure, rest = b.filter(pc.invert(several)), b.filter(several)
            for part, spans, text in ((sure, _scanned(sure.column(1), compiled) if sure.num_rows else [], pa.nulls(sure.num_rows, pa.string())), (rest, [None] * rest.num_rows, rest.column(1).cast(pa.string()))):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(_SPAN)), text, part.column(4)], ["blob", "spans", "text", "path"])

    once = written(arrow_stage(rows, run, out), "scanned")
    several = once.where("text is not null").select("blob", "path", "text")
    stand = new.select(F.col("blob").alias("new_blob"), "first")
    several = several.join(stand, (F.col("blob") == F.col("new_blob")) & F.col("path").eqNullSafe(F.col("first"))).select("blob", "text")

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(rules)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scanned(b.column(1), compiled), pa.list_(_SPAN))], ["blob", "spans"])

    late = arrow_stage(several, later, f"blob binary, spans {SPANS}")
    every = once.where("text is null").select("blob", "spans").unionByName(late)
    return written(every.groupBy("blob").agg(F.min("spans").alias("spans")), "findings")


def scan(docs: DataFrame, path: Column | None = None, ledger: Ledger | None = None, rules: tuple = RULES) -> DataFrame:
    """path, blob, spans for each row of docs (text). The ledger is read, and what is scanned now is added to it."""
    path = F.col("doc_id").cast("bigint") if path is None else path
    ledger = ledger or Ledger(docs.sparkSession)
    known = ledger.of(version(rules))
    versions = written(docs.select(path.alias("path"), address().alias("blob")), "versions")
    found = scan_new(docs, path, versions, known, rules)
    ledger.add(version(rules), found)
    hits = found.unionByName(known.join(versions.select("blob"), "blob", "left_semi")).where(F.size("spans") > 0).dropDuplicates(["blob"])
    hits = written(hits, "hits")  # so that the engine can split the rows of a blob that very many paths hold
    return versions.join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
