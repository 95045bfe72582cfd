"""Ranked lexical search over impact-ordered postings, score at a time.

`build` counts the terms of every document and writes an index of blocks of whole documents: a row for each term of a
block with its documents and frequencies, and one for the block's documents. `search` takes the rows of the terms that are
asked for, brings each block's rows together, and groups their postings by exact impact, highest first. For each item the
groups of all its terms are processed by descending contribution to the score, until what the terms can still add is less
than the k-th best score: then no document outside the candidates can be among the best, and the candidates' scores are
completed by looking them up. A task carries the best scores of the blocks it has seen on to its next blocks, so that
these stop earlier or are passed over whole. Nothing is approximate: the stop is proved by the bounds.

Terms: A-Z lower-cased, then runs of bytes that are digits, letters or not ASCII. A term's weight is
floor(1000 ln((2N + 2) / (2 df + 1))); a document's part of it is (10^9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L.
Cases: null or wordless texts have no terms and are in no result; an item without terms has none; a row is a document and
an item each, so repeated rows are found as often as they stand; equal scores go by doc_id, those without one last; other
columns are not looked at, whatever they are called; a very long text is in a block of its own; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, slices, table, words, written

#: Bytes of text in a block of the index; a longer document ends its block.
BLOCK_BYTES = 16 << 20
#: Characters of items that are searched for at once: their terms and weights are what is broadcast.
PART_CHARS = 2_000_000
#: Postings that a first step processes; each step takes twice as many as the one before.
FIRST_STEP = 2048

INDEX = "block bigint, term binary, df bigint, total bigint, docs array<int>, tfs array<int>, ids array<bigint>"
_INDEX = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("total", pa.int64()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
#: Stands where a term would in the row of a block's documents; no term is empty.
DOCUMENTS = b""


@dataclass(frozen=True)
class Index:
    """postings: INDEX; in a block's DOCUMENTS row docs has the documents' numbers of terms. n_docs have a term, n_terms are all."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def _counted(b: pa.RecordBatch) -> tuple:
    """Of a slice (doc_id, text): ids, terms of each document, the distinct terms, and a term, document and frequency for each posting."""
    packed, before = words(b.column(1))
    lengths = np.diff(before)
    coded = packed.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, tf = np.unique(codes << 32 | np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
    return b.column(0), lengths, coded.dictionary, keys >> 32, keys & 0xFFFFFFFF, tf


def _block(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows of one block: its documents, then its terms."""
    ids = pa.concat_arrays([x[0] for x in held])
    lengths = np.concatenate([x[1] for x in held])
    sizes, rows = [len(x[2]) for x in held], [len(x[1]) for x in held]
    coded = pa.concat_arrays([x[2] for x in held]).dictionary_encode()
    names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    term = names[np.concatenate([x[3] + at for x, at in zip(held, np.cumsum([0, *sizes[:-1]]), strict=True)])]
    doc = np.concatenate([x[4] + at for x, at in zip(held, np.cumsum([0, *rows[:-1]]), strict=True)])
    tf = np.concatenate([x[5] for x in held])
    order = np.argsort(term, kind="stable")  # documents stay in order
    counts = np.bincount(term, minlength=len(coded.dictionary))
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    lists = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x[order].astype(np.int32)))
    yield table({"block": [number], "term": [DOCUMENTS], "df": [int((lengths > 0).sum())], "total": [int(lengths.sum())], "docs": [lengths.astype(np.int32)], "tfs": [None], "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}, _INDEX)
    n = len(counts)
    if n:
        yield table({"block": np.full(n, number), "term": coded.dictionary.cast(pa.binary()), "df": counts, "total": pa.nulls(n, pa.int64()), "docs": lists(doc), "tfs": lists(tf), "ids": pa.nulls(n, _INDEX.field("ids").type)}, _INDEX)


def build(docs: DataFrame) -> Index:
    """The index of all terms of all documents, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for b in slices(batch):
                held.append(_counted(b))
                size += int(pa.compute.sum(pa.compute.binary_length(b.column(1))).as_py() or 0)
                if size >= BLOCK_BYTES:
                    yield from _block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield from _block(number, held)

    postings = written(arrow_stage(docs.select(F.col("doc_id").cast("bigint"), "text"), run, INDEX), "postings")
    n = postings.where(F.col("term") == F.lit(DOCUMENTS)).agg(F.sum("df"), F.sum("total")).head()
    return Index(postings, n[0] or 0, n[1] or 0)


class Impacts:
    """A block's postings of some terms, grouped by exact impact. Terms are numbers."""

    def __init__(self, lengths: np.ndarray, ids: pa.Array, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_terms: int, n_docs: int, total: int):
        self.n, self.ids = len(lengths), ids
        m = 25 + 75 * lengths * n_docs // total
        term = np.repeat(terms, counts)
        impact = 10**9 * tfs // (1000 * tfs + 8 * m[docs])
        #: (term, document), ascending, with the impact: where a document is looked up.
        self.keys, self.found = term * self.n + docs, impact
        order = np.argsort((term << 21) - impact, kind="stable")  # an impact is at most 10^6
        term, impact, self.docs = term[order], impact[order], docs[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])
        self.start = np.append(np.flatnonzero(new), len(term))
        self.impact = impact[self.start[:-1]]
        self.first = np.searchsorted(term[self.start[:-1]], np.arange(n_terms + 1))  # a term's groups

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their exact scores: all whose score is among the k highest here and at least `least`; some more may be there."""
        counts = self.first[terms + 1] - self.first[terms]
        terms, weights, counts = terms[counts > 0], weights[counts > 0], counts[counts > 0]
        ends = np.cumsum(counts)
        of = np.repeat(np.arange(len(terms)), counts)
        group = np.arange(int(counts.sum())) + np.repeat(self.first[terms] - ends + counts, counts)
        gain = weights[of] * self.impact[group]
        ahead = np.append(gain, 0)
        left = int(ahead[ends - counts].sum())
        if not len(terms) or left < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(-gain, kind="stable")
        sizes = (self.start[1:] - self.start[:-1])[group[order]]
        upto = np.cumsum(sizes)
        score, done, step, bar, at = np.zeros(self.n, np.int64), 0, FIRST_STEP, least, np.zeros(len(terms), np.int64)
        while done < len(order):
            to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step, side="right")))
            part, n = order[done:to], sizes[done:to]
            where = np.arange(int(n.sum())) + np.repeat(self.start[group[part]] - np.cumsum(n) + n, n)
            np.add.at(score, self.docs[where], np.repeat(gain[part], n))
            at += np.bincount(of[part], minlength=len(terms))
            done, step = to, 2 * step
            left = int(np.where(at < counts, ahead[ends - counts + at], 0).sum())
            if self.n >= k:
                bar = max(bar, int(np.partition(score, self.n - k)[self.n - k]))
            if left < bar:  # no document that isn't at the bar with all that is left can reach it
                break
        chosen = np.flatnonzero(score + left >= max(bar, 1))
        if left and len(chosen):
            key = (terms[:, None] * self.n + chosen[None, :]).ravel()
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            full = (np.where(self.keys[place] == key, self.found[place], 0).reshape(len(terms), -1) * weights[:, None]).sum(axis=0)
        else:
            full = score[chosen]
        keep = full >= max(bar, 1)
        return chosen[keep], full[keep]


_BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by block, a block at a time."""
    held, number = [], None
    for b in batches:
        blocks = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                if held and blocks[i] != number:
                    yield pa.Table.from_batches(held)
                    held = []
                number = blocks[i]
                held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _terms(items: DataFrame) -> DataFrame:
    """item, term, n: how often each item (item, text) has each of its terms."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                packed, before = words(b.column(1))
                yield table({"item": np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(before)), "term": packed.cast(pa.binary())}, schema)

    return arrow_stage(items.select("item", "text"), run, "item bigint, term binary").groupBy("item", "term").agg(F.count(F.lit(1)).alias("n"))


def _best_of_tasks(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """item, doc_id, score: of each task's blocks the k best, for a bounded part of the items. terms: item, term, n."""
    spark = terms.sparkSession
    often = index.postings.select("term", "df").join(F.broadcast(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.n_docs + 2) / (2 * F.col("df") + 1)))
    rows = terms.join(often, "term").select("item", "term", (weight * F.col("n")).cast("bigint").alias("weight")).where("weight > 0").collect()  # bounded by PART_CHARS
    number = {t: i for i, t in enumerate(sorted({bytes(r.term) for r in rows}))}
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.item, []).append((number[bytes(r.term)], r.weight))
    queries = [(i, *(np.array(x, np.int64) for x in zip(*sorted(v), strict=True))) for i, v in sorted(by.items())]
    shared = spark.sparkContext.broadcast(queries)
    wanted = spark.createDataFrame([(bytearray(t), i) for t, i in [(DOCUMENTS, -1), *number.items()]], "term binary, number int")
    lists = index.postings.join(F.broadcast(wanted), "term").select("block", "number", "docs", "tfs", "ids")
    n_terms, n_docs, total = len(number), index.n_docs, index.n_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}  # sorted: minus the score, whether the id is missing, the id
        for block in _whole_blocks(batches):
            block = block.combine_chunks()
            flat = lambda c, b=block: b.column(c).chunk(0).flatten()
            number = block.column("number").to_numpy()
            counts = pa.compute.list_value_length(block.column("docs")).to_numpy()
            docs, ids = flat("docs").to_numpy(zero_copy_only=False).astype(np.int64), flat("ids")
            here = Impacts(docs[: counts[0]], ids, number[1:].astype(np.int64), counts[1:], docs[counts[0] :], flat("tfs").to_numpy(zero_copy_only=False).astype(np.int64), n_terms, n_docs, total)
            for item, terms, weights in shared.value if len(number) > 1 else ():
                known = best.get(item, [])
                doc, score = here.best(terms, weights, k, max(1, -known[-1][0]) if len(known) == k else 1)
                if len(doc):
                    found = [(-s, i is None, i or 0) for s, i in zip(score.tolist(), ids.take(pa.array(doc)).to_pylist(), strict=True)]
                    best[item] = sorted(known + found)[:k]
        out = [(item, None if lost else i, -s) for item, each in best.items() for s, lost, i in each]
        if out:
            yield table(dict(zip(_BEST.names, map(list, zip(*out, strict=True)), strict=True)), _BEST)

    return arrow_stage(lists.repartition("block").sortWithinPartitions("block", "number"), run, "item bigint, doc_id bigint, score bigint")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: of each item (item_id, text) the k documents of highest score above 0."""
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    chars = asked.agg(F.sum(F.length("text"))).head()[0] or 0
    n = 1 + chars // PART_CHARS
    found = []
    for i in range(n):
        terms = written(_terms(asked if n == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i)), "item-terms")
        own = _best_of_tasks(index, terms, k)
        found.append(own if n == 1 else written(own, "best"))
    every = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
