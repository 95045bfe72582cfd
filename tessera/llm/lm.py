"""Language-model scores of documents: stupid backoff over n-gram counts of the whole corpus.

Every document is scored by the counts of all other documents: c(g) is the corpus count of an n-gram less the
document's own. A word's value is c(context word) / c(context) for the longest context for which c(context word) > 0,
times BACKOFF for each context given up; without any, its share of all words, or 1 / (words + 1) if it occurs nowhere else.

`score_rows` says this in plain relations: a count table by hash, joined to the exploded distinct n-grams of each document
and summed per document. Each n-gram is a row there, which takes more disk than is allowed (README), so `score` packs
the same relations. A row of `blocks` holds the words of some documents as numbers. Each block sends its
distinct n-grams with their counts to the partitions of the count table, by hash; there the lists are joined to the
sums over all blocks and go back as what the other blocks have; the block then sums per document. A block sends an
n-gram once however often it occurs, so frequent ones make no partition large.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. n-grams are 64-bit hashes.
Cases: texts are read whole, however long (one over BLOCK_BYTES is a block of its own); columns other than doc_id and text
are not looked at, whatever they are called; documents without words (or null) have score null; repeated rows count as documents of their own; a corpus of
one document scores each of its words 1 / 1; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, slices, table, words, written

#: Of op4_lm_scores, as its SQL has it; op4_trigram_scores takes 3. Disk grows with it, as nearly every n-gram of three words is a new one.
ORDER = 2
BACKOFF = 0.4
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: n-grams that a partition of the count table is meant to hold.
PARTITION_GRAMS = 1 << 20

BLOCKS = "block bigint, doc_ids array<bigint>, first_words array<int>, vocabulary binary, codes binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first_words", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("codes", pa.binary())])


def blocks(docs: DataFrame) -> DataFrame:
    """The corpus as a written table of blocks; vocabulary has the words' hashes, codes a place in it for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", BLOCK_BYTES):
                packed, before = words(b.column(2))
                coded = packed.dictionary_encode()
                hashes = b"".join([xxhash.xxh3_64_digest(x.as_py()) for x in coded.dictionary])
                yield table({"block": b.column(0)[:1], "doc_ids": [b.column(1).to_pylist()], "first_words": [before.astype(np.int32)], "vocabulary": [hashes], "codes": [coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32).tobytes()]}, _BLOCKS)

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("bigint"), "text")
    return written(arrow_stage(rows, run, BLOCKS), "blocks", "zstd")


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (context ^ (context >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Grams:
    """The n-grams of a block: hashes and counts of the distinct ones, and for each word and length (less 1) the number of the one that ends there."""

    def __init__(self, first_words: np.ndarray, vocabulary: bytes, codes: bytes, order: int):
        self.first = np.asarray(first_words, np.int64)
        word = np.frombuffer(vocabulary, "<u8")[np.frombuffer(codes, np.uint32)].astype(np.uint64) if codes else np.zeros(0, np.uint64)
        self.place = np.arange(len(word)) - np.repeat(self.first[:-1], np.diff(self.first))  # of a word in its document
        hashes = [word]
        for _ in range(1, order):
            longer = word.copy()
            longer[1:] = _mixed(hashes[-1][:-1], word[1:])
            hashes.append(longer)
        there = [self.place >= k for k in range(order)]
        self.hashes, number, self.counts = np.unique(np.concatenate([h[t] for h, t in zip(hashes, there, strict=True)]), return_inverse=True, return_counts=True)
        self.number = []
        for t, own in zip(there, np.split(number, np.cumsum([int(t.sum()) for t in there])[:-1]), strict=True):
            x = np.full(len(word), -1, np.int64)
            x[t] = own
            self.number.append(x)

    def scores(self, others: np.ndarray, all_words: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """Per document: the mean log10 value of its words (nan without words), and its words whose context is not seen elsewhere with them."""
        n_words = np.diff(self.first)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        total, wide = others + self.counts, len(self.hashes) + 1
        elsewhere = []
        for x in self.number:
            _, inverse, mine = np.unique(doc * wide + x, return_inverse=True, return_counts=True)
            elsewhere.append(np.where(x >= 0, total[x] - mine[inverse], 0) if len(x) else x)
        left = all_words - n_words[doc]
        value = np.where(elsewhere[0] > 0, elsewhere[0] / np.maximum(left, 1), 1 / (left + 1))
        seen = np.zeros(len(value), bool)
        for k in range(1, len(self.number)):
            context = np.zeros(len(value), np.int64)
            context[1:] = elsewhere[k - 1][:-1]  # the n-gram a word shorter that ends at the word before
            longer = elsewhere[k] > 0
            value = np.where(longer, elsewhere[k] / np.maximum(context, 1), np.where(self.place >= k, backoff * value, value))
            seen |= longer
        logs = np.bincount(doc, weights=np.log10(value), minlength=len(n_words))
        return logs / np.where(n_words > 0, n_words, np.nan), np.bincount(doc[~seen], minlength=len(n_words))


PACKED = "part bigint, block bigint, data binary"
_PACKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {k: b.column(k)[i].as_py() for k in names}


def _grams(row: dict, order: int) -> Grams:
    return Grams(np.asarray(row["first_words"]), row["vocabulary"], row["codes"], order)


def _ask(order: int, bits: int):
    """Each block's distinct n-grams to the partitions that their first bits name: sorted, as differences, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, ("block", "first_words", "vocabulary", "codes")):
            g = _grams(row, order)
            part = (g.hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g.hashes), np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            packed = [pack(g.hashes[i:j], g.counts[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield table({"part": part[cuts[:-1]], "block": [row["block"]] * len(packed), "data": packed}, _PACKED)

    return run


def pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes as differences by byte planes, so that their empty upper bytes vanish, then the counts."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    used = max([i + 1 for i in range(8) if planes[i, 1:].any()], default=0)
    head = np.array([len(hashes), used, 0 if not len(hashes) else int(hashes[0])], "<u8").tobytes()
    return head + planes[:used, 1:].tobytes() + zlib.compress(counts.astype("<u4").tobytes(), 1)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, used, first = (int(x) for x in np.frombuffer(data, "<u8", 3))
    steps = np.zeros((n, 8), np.uint8)
    if used:
        steps[1:, :used] = np.frombuffer(data, np.uint8, used * (n - 1), 24).reshape(used, n - 1).T
    hashes = steps.view("<u8").ravel().astype(np.uint64)
    if n:
        hashes[0] = first
    return np.cumsum(hashes, dtype=np.uint64), np.frombuffer(zlib.decompress(data[24 + used * max(0, n - 1) :]), "<u4").astype(np.int64)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of the count table: the sums over all blocks, and for each block what the others have of its n-grams."""

    def answers(part: int, asked: list[tuple[int, bytes]]) -> pa.RecordBatch:
        lists = [unpack(x) for _, x in asked]
        grams, at = np.unique(np.concatenate([h for h, _ in lists]), return_inverse=True)
        counts = np.concatenate([c for _, c in lists])
        others = np.bincount(at, weights=counts, minlength=len(grams)).astype(np.int64)[at] - counts
        each = np.split(others, np.cumsum([len(h) for h, _ in lists])[:-1])
        return table({"part": [part] * len(asked), "block": [b for b, _ in asked], "data": [zlib.compress(x.astype("<u4").tobytes(), 1) for x in each]}, _PACKED)

    held: list[tuple[int, bytes]] = []
    part = None
    for row in _rows(batches, ("part", "block", "data")):
        if held and row["part"] != part:
            yield answers(part, held)
            held = []
        part = row["part"]
        held.append((row["block"], row["data"]))
    if held:
        yield answers(part, held)


SCORES = "doc_id bigint, n_words bigint, n_backed_off bigint, lm_score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("lm_score", pa.float64())])


def _sum(order: int, all_words: int, backoff: float):
    """Rows sorted by block, its words (part -1) first and then the answers in the order of its n-grams, to scores."""

    def scored(own: dict, data: list[bytes]) -> pa.RecordBatch:
        g = _grams(own, order)
        others = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for x in data]).astype(np.int64) if data else np.zeros(0, np.int64)
        score, back = g.scores(others, all_words, backoff)
        return table({"doc_id": own["doc_ids"], "n_words": np.diff(g.first), "n_backed_off": back, "lm_score": pa.array(score, from_pandas=True)}, _SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, data = None, []
        for b in batches:
            for i in range(b.num_rows):
                if b.column("part")[i].as_py() >= 0:
                    data.append(b.column("data")[i].as_py())
                    continue
                if own is not None:
                    yield scored(own, data)
                own, data = {k: b.column(k)[i].as_py() for k in ("doc_ids", "first_words", "vocabulary", "codes")}, []
        if own is not None:
            yield scored(own, data)

    return run


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, n_backed_off (words that no document has elsewhere in their context), lm_score (mean log10)."""
    corpus = blocks(docs)
    all_words = corpus.agg(F.sum(F.element_at("first_words", -1).cast("bigint"))).head()[0] or 0
    bits = max(0, (order * all_words // PARTITION_GRAMS).bit_length())
    asked = arrow_stage(corpus.select("block", "first_words", "vocabulary", "codes"), _ask(order, bits), PACKED)
    answered = arrow_stage(asked.repartition("part").sortWithinPartitions("part"), _answer, PACKED)
    own = corpus.select(F.lit(-1).cast("bigint").alias("part"), "block", F.lit(None).cast("binary").alias("data"), "doc_ids", "first_words", "vocabulary", "codes")
    back = answered.select("part", "block", "data", *[F.lit(None).cast(t).alias(k) for k, t in (("doc_ids", "array<bigint>"), ("first_words", "array<int>"), ("vocabulary", "binary"), ("codes", "binary"))])
    rows = own.unionByName(back).repartition("block").sortWithinPartitions("block", "part")
    return arrow_stage(rows, _sum(order, all_words, backoff), SCORES)


def score_rows(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """score() with a row for each n-gram, by the engine's own joins and aggregations."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0).alias("w"))
    texts = written(texts, "texts")
    all_words = texts.agg(F.sum(F.size("w"))).head()[0] or 0
    gram = lambda at, k: F.when(at >= k, F.xxhash64(F.array_join(F.slice("w", at - k + 1, k + 1), " ")))  # noqa: E731  of k + 1 words that end at `at`
    ends = F.transform("w", lambda _, at: F.array(*[gram(at, F.lit(k)) for k in range(order)]))
    grams = texts.select("row", F.posexplode(ends).alias("at", "hs")).select("row", "at", F.posexplode("hs").alias("k", "h")).where("h is not null")
    own = grams.groupBy("row", "k", "h").agg(F.count(F.lit(1)).alias("own"))
    counts = own.groupBy("k", "h").agg(F.sum("own").alias("total"))
    others = own.join(written(counts, "counts"), ["k", "h"]).select("row", "k", "h", (F.col("total") - F.col("own")).alias("others"))
    each = grams.join(others, ["row", "k", "h"]).groupBy("row", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "others"))), lambda x: x["others"]).alias("e"))
    each = each.withColumn("before", F.lag("e").over(Window.partitionBy("row").orderBy("at"))).join(texts.select("row", F.size("w").alias("n")), "row")  # a document's words
    got = lambda c, k: F.coalesce(F.get(c, F.lit(k)), F.lit(0))
    left = F.lit(all_words) - F.col("n")
    value, seen = F.when(got("e", 0) > 0, got("e", 0) / F.greatest(left, F.lit(1))).otherwise(1 / (left + 1)), F.lit(False)
    for k in range(1, order):
        longer = got("e", k) > 0
        value = F.when(longer, got("e", k) / F.greatest(got("before", k - 1), F.lit(1))).when(F.col("at") >= k, backoff * value).otherwise(value)
        seen = seen | longer
    scores = each.groupBy("row").agg(F.avg(F.log10(value)).alias("lm_score"), F.count_if(~seen).alias("n_backed_off"))
    return texts.join(scores, "row", "left").select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.coalesce("n_backed_off", F.lit(0)).alias("n_backed_off"), "lm_score")
