"""Exact line deduplication across documents, with compressed bitmaps of the lines that stay.

Line hashes are range-partitioned with their document and sorted by (hash, document, position), so the lines of a
very common key lie in many partitions. A stream over each partition settles every key that it sees whole; the
two keys at the ends of a batch are left open with what was counted of them, and joined to their totals. What
comes back is a bitmap of kept lines per document, not text.

A line's key is the line without [space, \\t-\\r] at its ends, A-Z lower-cased. Keys shorter than `least` code points
stay everywhere. Keys of at least `least_docs` documents stay only in the largest doc_id that has them, with all their lines there.
Cases: null or empty text is one empty line; rows of one doc_id are one document, rows without doc_id together
another, smaller than all; repeated rows share their bitmap; a very long text is split whole, in the task that has it; further columns
are carried along in `row`, whatever they are called; an empty table gives empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, fresh, table, written

STRIPPED = b" \t\n\x0b\x0c\r"
#: Stands for a missing doc_id in comparisons.
NO_DOC = -(1 << 63)

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32())])
LINES = "h1 bigint, h2 bigint, doc bigint, text_hash bigint, line int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc (doc_id, or NO_DOC) and text_hash, which name a row of documents here; its text; and all its columns as `row`."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_DOC)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text", F.struct("*").alias("row"))


def line_hashes(docs: DataFrame, least: int = 40) -> DataFrame:
    """A row for each line whose key has at least `least` code points, with the key's 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            hashes, counts, numbers = [], [], []
            for text in b.column(2).cast(pa.large_binary()):
                n = len(hashes)
                for i, line in enumerate((text.as_py() or b"").split(b"\n")):
                    if len(line) >= least:
                        key = line.strip(STRIPPED)
                        if len(key) >= least and (key.isascii() or len(key.decode()) >= least):
                            hashes.append(digest(key.lower()))
                            numbers.append(i)
                counts.append(len(hashes) - n)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            doc, text_hash = (np.repeat(b.column(i).to_numpy(zero_copy_only=False), counts) for i in (0, 1))
            yield table({"h1": np.ascontiguousarray(h[:, 0]), "h2": np.ascontiguousarray(h[:, 1]), "doc": doc, "text_hash": text_hash, "line": np.array(numbers, np.int32)}, _LINES)

    return arrow_stage(keyed(docs).select("doc", "text_hash", "text"), run, LINES)


#: kind 0: a line to drop; 1: a line of a key that is still open; 2: what a batch counted of an open key.
_FOUND = pa.schema([*_LINES, ("kind", pa.int32()), ("n", pa.int64())])


def _settle(least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # key and document of the last row so far
        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, doc, text_hash, line = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            new_key = np.ones(len(h1), bool)
            new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            if before == (h1[0], h2[0], doc[0]):
                new_doc[0] = False
            before = (h1[-1], h2[-1], doc[-1])
            first = np.flatnonzero(new_key)
            last = np.append(first[1:], len(h1)) - 1
            n = np.add.reduceat(new_doc.astype(np.int64), first)
            run_of = np.cumsum(new_key) - 1
            opened = np.zeros(len(first), bool)
            opened[[0, -1]] = True
            drop = np.flatnonzero(((n >= least_docs) & ~opened)[run_of] & (doc != doc[last][run_of]))
            rest = np.flatnonzero(opened[run_of])
            rows, ends = np.concatenate([drop, rest]), last[opened]
            ends = np.unique(ends)
            at = np.concatenate([rows, ends])
            kind = np.repeat(np.array([0, 1, 2], np.int32), [len(drop), len(rest), len(ends)])
            yield table({"h1": h1[at], "h2": h2[at], "doc": doc[at], "text_hash": text_hash[at], "line": line[at], "kind": kind, "n": np.where(kind == 2, n[run_of[at]], 0)}, _FOUND)

    return run


def drops(docs: DataFrame, least: int = 40, least_docs: int = 5) -> DataFrame:
    """doc, text_hash, line: the lines that go."""
    # written, as the range partitioner reads it twice
    lines = written(line_hashes(docs, least), "lines")
    ordered = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "text_hash", "line")
    found = written(arrow_stage(ordered, _settle(least_docs), f"{LINES}, kind int, n bigint"), "lines-found")
    total = found.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("doc").alias("kept")).where(F.col("n") >= least_docs)
    # an open key may have a large part of all lines: its total is written first, so that the engine can split the lines that meet it
    total = written(total, "totals")
    late = found.where("kind = 1").join(total.select("h1", "h2", "kept"), ["h1", "h2"]).where("doc <> kept")
    return found.where("kind = 0").select("doc", "text_hash", "line").unionByName(late.select("doc", "text_hash", "line"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """doc, text_hash, keep: for each document that loses lines, zlib-compressed bits, 1 for a line that stays; lines after the last bit stay."""
    schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("keep", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for at in b.column(2):
                at = at.values.to_numpy(zero_copy_only=False)
                bits = np.ones(-(-(int(at.max()) + 1) // 8) * 8, bool)
                bits[at] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield table({"doc": b.column(0), "text_hash": b.column(1), "keep": keep}, schema)

    return arrow_stage(dropped.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("lines")), run, "doc bigint, text_hash bigint, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text of the lines that stay, the number of lines, and how many go."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    gone = set(np.flatnonzero(bits == 0).tolist())
    return b"\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)


def with_bitmaps(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """row (all columns of docs), text and keep: null where all lines stay."""
    k = keep.select(F.col("doc").alias("k_doc"), F.col("text_hash").alias("k_hash"), "keep")
    rows = keyed(docs)
    return rows.join(k, (F.col("doc") == F.col("k_doc")) & (F.col("text_hash") == F.col("k_hash")), "left").select("row", "text", "keep")


def deduplicated(docs: DataFrame, least: int = 40, least_docs: int = 5) -> DataFrame:
    """The rows of docs, all columns, with the lines that stay; n_chars follows the text."""
    mark = fresh(docs, "keep")
    rows = with_bitmaps(docs, bitmaps(drops(docs, least, least_docs))).select("row.*", F.col("keep").alias(mark))
    at, keep = docs.columns.index("text"), len(docs.columns)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t.as_py() is None else kept_lines(t.as_py(), k.as_py())[0] for t, k in zip(b.column(at).cast(pa.large_binary()), b.column(keep), strict=True)]
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else c for i, c in enumerate(b.columns[:keep])]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:keep])

    out = arrow_stage(rows, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
