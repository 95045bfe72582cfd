"""A document-partitioned positional inverted index, with exact phrase and proximity search.

`build` stores, for blocks of whole documents, each term's token positions. `windows` finds every place where a
phrase window of a test item stands: the lists of its terms, shifted by their offsets, are intersected from the
rarest term of the block on. As a block holds whole documents, no list ever leaves its block, so a frequent term
costs each block only its own postings and nothing is shuffled.

Words: A-Z lower-cased, then runs of bytes that are digits, letters or not ASCII.
Cases: null or wordless texts have no words and are never hit; null items have none; an item without id is hit but
not named; repeated rows are each reported; a very long text is a block of its own; columns other than doc_id and text (item_id
and text) are not looked at, whatever they are called; an empty index or no items give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, slices, table, words, written

#: Bytes of text in a block of the index; a longer document has one for itself.
BLOCK_BYTES = 400_000
#: Words of test items that are broadcast at once; more items are searched for in several passes.
BROADCAST_WORDS = 2_000_000

INDEX = "row_ids array<bigint>, doc_ids array<bigint>, first_words array<int>, terms array<binary>, first_postings binary, postings binary"
_INDEX = pa.schema([("row_ids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("first_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.large_binary())), ("first_postings", pa.binary()), ("postings", pa.binary())])


def build(docs: DataFrame) -> DataFrame:
    """The index as a written table: a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", BLOCK_BYTES):
                packed, before = words(b.column(2))
                coded = packed.dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                counts = np.bincount(codes, minlength=len(coded.dictionary))
                postings = np.argsort(codes, kind="stable").astype(np.uint16 if len(codes) < 1 << 16 else np.uint32)
                first = np.zeros(len(counts) + 1, np.uint32)
                np.cumsum(counts, out=first[1:])
                yield table({"row_ids": [b.column(0).to_pylist()], "doc_ids": [b.column(1).to_pylist()], "first_words": [before.astype(np.int32)], "terms": pa.LargeListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int64()), coded.dictionary).cast(_INDEX.field("terms").type), "first_postings": [first.tobytes()], "postings": [postings.tobytes()]}, _INDEX)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint"), "text")
    return written(arrow_stage(rows, run, INDEX), "index")


class Block:
    """One row of the index."""

    def __init__(self, row: dict):
        self.row_ids, self.doc_ids = row["row_ids"], row["doc_ids"]
        self.first_words = np.asarray(row["first_words"], np.int64)
        self.n = int(self.first_words[-1])
        self.terms = row["terms"]
        self.first = np.frombuffer(row["first_postings"], np.uint32).astype(np.int64)
        self.postings = np.frombuffer(row["postings"], np.uint16 if self.n < 1 << 16 else np.uint32).astype(np.int64)
        #: (term, position), ascending: whether a list has a position is one search here.
        self.keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * max(self.n, 1) + self.postings

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        """This block's number of each term of a vocabulary; -1 where it doesn't occur."""
        out = np.full(len(vocabulary) + 1, -1, np.int64)
        found = pc.index_in(self.terms, value_set=vocabulary)
        here = np.flatnonzero(np.asarray(found.is_valid()))
        out[np.asarray(found.fill_null(0))[here]] = here
        return out

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first_words, positions, side="right") - 1

    def phrases(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """wanted: a row of this block's term numbers for each phrase, all of one length. The phrase and start of each match."""
        which, k = np.flatnonzero((wanted >= 0).all(axis=1)), wanted.shape[1]
        if not len(which):
            return which, which
        wanted = wanted[which]
        sizes = self.first[wanted + 1] - self.first[wanted]
        order = np.argsort(sizes, axis=1, kind="stable")  # the rarest term first
        rarest = order[:, 0]
        term = wanted[np.arange(len(which)), rarest]
        n = self.first[term + 1] - self.first[term]
        phrase = np.repeat(np.arange(len(which)), n)
        at = self.postings[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[term], n)]
        start = at - rarest[phrase]
        keep = (start >= 0) & (start + k <= self.n)
        phrase, start = phrase[keep], start[keep]
        for j in range(1, k):
            if not len(phrase):
                break
            offset = order[phrase, j]
            key = wanted[phrase, offset] * self.n + start + offset
            at = np.searchsorted(self.keys, key)
            keep = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            phrase, start = phrase[keep], start[keep]
        keep = self.doc_of(start) == self.doc_of(start + k - 1)
        return which[phrase[keep]], start[keep]

    def near(self, terms: np.ndarray, span: int) -> list[tuple[int, int]]:
        """The smallest stretches of at most `span` words of one document that hold all of a phrase's terms, in any order."""
        terms = np.unique(terms)
        if not len(terms) or terms[0] < 0:
            return []
        lists = sorted((self.postings[self.first[t] : self.first[t + 1]] for t in terms), key=len)
        found = set()
        for p in lists[0]:  # the rarest term stands in every stretch
            around = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)] for x in lists[1:]]
            if any(not len(x) for x in around):
                continue
            at = np.concatenate([[p], *around])
            what = np.repeat(np.arange(len(lists)), [1, *map(len, around)])
            order = np.argsort(at, kind="stable")
            latest: dict[int, int] = {}
            best = None
            for x, w in zip(at[order], what[order], strict=True):
                latest[int(w)] = int(x)
                if len(latest) == len(lists):
                    low = min(latest.values())
                    if x - low < span and self.doc_of(np.array([low]))[0] == self.doc_of(np.array([x]))[0] and (best is None or x - low < best[1] - best[0]):
                        best = (low, int(x))
            if best:
                found.add((best[0], best[1] + 1))
        return sorted(found)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            out = {k: row.column(k)[0].as_py() for k in ("row_ids", "doc_ids", "first_words", "first_postings", "postings")}
            yield Block(out | {"terms": row.column("terms").flatten().cast(pa.large_binary())})


class Queries:
    """Test items as distinct windows of term numbers, each with the items that have it; small enough to broadcast."""

    def __init__(self, items: list[tuple[int | None, str | None]], length: int):
        packed, before = words(pa.array([t for _, t in items], pa.large_string()))
        coded = packed.dictionary_encode()
        self.vocabulary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = [i for i, _ in items]
        self.terms = [codes[before[i] : before[i + 1]] for i in range(len(items))]
        self.windows: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, t in enumerate(self.terms):
            if len(t):
                by.setdefault(min(len(t), length), []).append((i, t))
        for k, found in by.items():
            rows = [np.lib.stride_tricks.sliding_window_view(t, k) for _, t in found]
            distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            names: list[set[int]] = [set() for _ in distinct]
            for w, i in zip(which.ravel().tolist(), np.repeat([i for i, _ in found], [len(x) for x in rows]).tolist(), strict=True):
                if self.ids[i] is not None:
                    names[w].add(self.ids[i])
            self.windows[k] = distinct, [sorted(x) for x in names]


MATCHES = "row_id bigint, doc_id bigint, n_words bigint, spans array<struct<start:int,end:int>>, items array<bigint>"
_MATCHES = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])


def _search(index: DataFrame, queries: Queries) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for block in blocks(batches):
            spans: list[list] = [[] for _ in block.row_ids]
            items: list[set] = [set() for _ in block.row_ids]
            numbers = block.numbers(q.vocabulary)
            for k, (windows, named) in q.windows.items():
                which, start = block.phrases(numbers[windows])
                for d, s, w in zip(block.doc_of(start).tolist(), start.tolist(), which.tolist(), strict=True):
                    s -= int(block.first_words[d])
                    spans[d].append((s, s + k))
                    items[d].update(named[w])
            yield table({"row_id": block.row_ids, "doc_id": block.doc_ids, "n_words": np.diff(block.first_words), "spans": [[{"start": a, "end": b} for a, b in union(x)] for x in spans], "items": [sorted(x) for x in items]}, _MATCHES)

    return arrow_stage(index, run, MATCHES)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(items: DataFrame) -> Iterator[tuple[list[tuple[int | None, str | None]], bool]]:
    """The items in lists that may be broadcast, one after another, and whether a list is the last. Only their texts' lengths decide how many there are."""
    total = items.agg(F.sum(F.length("text"))).head()[0] or 0
    n = 1 + total // (4 * BROADCAST_WORDS)
    rows = items.select(F.col("item_id").cast("bigint"), "text")
    for i in range(n):
        yield [tuple(r) for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)).collect()], i == n - 1


def windows(index: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """Per document: row_id, doc_id, n_words, the stretches of words that windows of items cover, and those items' ids."""
    found = []
    for part, last in _parts(items):
        own = _search(index, Queries(part, length))
        found.append(own if last and not found else written(own, "matches"))  # the driver and the workers hold one part at a time
    if len(found) == 1:
        return found[0]
    every = reduce(DataFrame.unionByName, found)
    merged = every.groupBy("row_id", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"start": s, "end": e} for s, e in union([(x["start"], x["end"]) for x in row])] for row in b.column(3).to_pylist()]
            yield table({"row_id": b.column(0), "doc_id": b.column(1), "n_words": b.column(2), "spans": spans, "items": b.column(4)}, _MATCHES)

    return arrow_stage(merged.select("row_id", "doc_id", "n_words", "spans", "items"), run, MATCHES)


def proximity(index: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """row_id, doc_id, item_id, start, end: where all terms of an item stand within `span` words, in any order."""
    out = "row_id bigint, doc_id bigint, item_id bigint, start int, end int"
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    found = []
    for part, last in _parts(items):
        shared = index.sparkSession.sparkContext.broadcast(Queries(part, 1))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for block in blocks(batches):
                numbers, rows = block.numbers(q.vocabulary), []
                for i, terms in enumerate(q.terms):
                    for a, b in block.near(numbers[terms], span):
                        d = int(block.doc_of(np.array([a]))[0])
                        w = int(block.first_words[d])
                        rows.append((block.row_ids[d], block.doc_ids[d], q.ids[i], a - w, b - w))
                yield table(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in schema.names}, schema)

        own = arrow_stage(index, run, out)
        found.append(own if last and not found else written(own, "near"))
    return reduce(DataFrame.unionByName, found)
