"""Document fingerprints from prefix polynomial hashes.

`PrefixHashes` keeps, for two primes, the sums of c[j] * B^j up to each place. Any span's hash is then one subtraction
and one product, so span equality is answered at once and a longest common extension by binary search.
A fingerprint holds the hash of the whole text and, for SLOTS classes of its WINDOW-character spans, the smallest
span hash of the class; likeness estimates the share of spans that two texts have in common.

Characters are code points. Cases: texts are hashed whole, however long, in some 100 times their size; columns other than
doc_id and text are not looked at, whatever they are called; null text is the empty text; a text shorter than WINDOW is its own only span; the
empty text has none and is like itself only; equal doc_ids follow each other by text; rows without doc_id come last;
a single row is followed by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, table

WINDOW = 24
#: Classes of spans, by so many bits of their hash.
SLOT_BITS = 8
SLOTS = 1 << SLOT_BITS
#: Primes below 2^31, a base of each, and the bases' inverses.
PRIMES = ((2147483647, 1000003, pow(1000003, -1, 2147483647)), (2147483629, 1299721, pow(1299721, -1, 2147483629)))

_POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo the prime."""
    out = _POWERS.get((base, prime))
    if out is None or len(out) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        _POWERS[base, prime] = out
    return out[:n]


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for prime, base, _ in PRIMES:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * powers(base, prime, self.n) % np.uint64(prime), out=s[1:])
            self.sums.append(s % np.uint64(prime))

    def spans(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """62-bit hashes of the spans of `length` characters from `start`."""
        out = np.zeros(len(start), np.uint64)
        for s, (prime, _, inverse) in zip(self.sums, PRIMES, strict=True):
            p = np.uint64(prime)
            out = (out << np.uint64(31)) ^ ((s[start + length] + p - s[start]) % p * powers(inverse, prime, self.n + 1)[start] % p)
        return out

    def windows(self, length: int) -> np.ndarray:
        """The hashes of all spans of `length` characters."""
        n = self.n - length + 1
        out = np.zeros(n, np.uint64)
        for s, (prime, _, inverse) in zip(self.sums, PRIMES, strict=True):
            p = np.uint64(prime)
            out = (out << np.uint64(31)) ^ ((s[length:] + p - s[:n]) % p * powers(inverse, prime, n) % p)
        return out

    def whole(self) -> int:
        return int(self.spans(np.zeros(1, np.int64), self.n)[0])

    def common(self, start: int, other: PrefixHashes, at: int) -> int:
        """The longest common extension of this text from `start` and the other one from `at`."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            half = (low + high + 1) // 2
            if self.spans(np.array([start]), half)[0] == other.spans(np.array([at]), half)[0]:
                low = half
            else:
                high = half - 1
        return low


def fingerprint(hashes: PrefixHashes) -> str:
    """16 hex digits of the whole text, then 2 for each slot: 00 if no span falls there."""
    slots = np.zeros(SLOTS, np.uint8)
    if hashes.n:
        spans = hashes.windows(min(WINDOW, hashes.n))
        mixed = spans * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        slot = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, slot, mixed << np.uint64(SLOT_BITS))
        filled = np.bincount(slot, minlength=SLOTS) > 0
        least *= np.uint64(0xBF58476D1CE4E5B9)  # the smallest values have few bits left at their upper end
        least ^= least >> np.uint64(29)
        slots = np.where(filled, 1 + (least >> np.uint64(8)) % np.uint64(255), 0).astype(np.uint8)
    return format(hashes.whole() if hashes.n else 0, "016x") + slots.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """From two fingerprints, the estimated share of spans in common (twice the common ones over all of both)."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[16:]), np.uint8) for s in (a, b))
    some = (x > 0) | (y > 0)
    if not some.any():
        return 0.0
    both = min(1.0, max(0.0, (float((x == y)[some].mean()) - 1 / 255) / (1 - 1 / 255)))
    return 2 * both / (1 + both)


def buckets(doc: Column, bounds: list[int]) -> Column:
    """The number of bounds (descending) above doc, by two steps of about the square root of their number."""
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    array = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<bigint>")
    above = lambda xs: F.size(F.filter(xs, lambda v: v > doc))
    whole = above(array([g[-1] for g in groups]))  # groups whose bounds are all above
    fine = F.element_at(F.array(*[array(g) for g in groups], array([])), whole + 1)
    return whole * step + above(fine)


def followed(docs: DataFrame) -> DataFrame:
    """bucket, ahead, doc, doc_id, text: rows by descending doc_id in buckets, each with a copy (ahead) of the rows that the next bucket begins with."""
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("doc", F.coalesce("doc_id", F.lit(low)))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.approxQuantile("doc", [i / n for i in range(1, n)], 0.25 / n)
    bounds = sorted({int(x) for x in cuts}, reverse=True)
    rows = rows.withColumn("bucket", buckets(F.col("doc"), bounds))
    heads = sorted((r.bucket, r.head) for r in rows.groupBy("bucket").agg(F.max("doc").alias("head")).collect())  # at most n rows
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    ahead = spark.createDataFrame(before, "doc bigint, to int")
    rows = rows.join(F.broadcast(ahead), "doc", "left")
    copies = F.when(F.col("to").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("a")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("a")), F.struct(F.col("to").alias("b"), F.lit(True).alias("a"))))
    rows = rows.select(F.inline(copies).alias("bucket", "ahead"), "doc", "doc_id", "text")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.desc("doc"), "text")


COMPARED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_start bigint"


def compared(docs: DataFrame) -> DataFrame:
    """Every text with its edited text, whose second half is the start of the next document by descending doc_id.

    common_start: characters up to the first difference of the two, by binary search.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_start", pa.int64())])

    def pair(doc_id: int | None, text: str, own: PrefixHashes, mark: str, following: str, next_mark: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = PrefixHashes(edited)
        edited_mark = fingerprint(other)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark, likeness(mark, edited_mark), likeness(mark, next_mark), own.common(0, other, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, whose next row is still to come, and its bucket
        for b in batches:
            rows = []
            for bucket, ahead, doc_id, text in zip(*(b.column(i) for i in (0, 1, 3, 4)), strict=True):
                bucket, ahead = bucket.as_py(), ahead.as_py()
                if ahead and (held is None or held[0] != bucket):
                    continue  # a further copy
                text = text.as_py() or ""
                own = PrefixHashes(text)
                mark = fingerprint(own)
                if held is not None:
                    rows.append(pair(*held[1:], text, mark))
                held = None if ahead else (bucket, doc_id.as_py(), text, own, mark)
            if rows:
                yield table(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    return arrow_stage(followed(docs), run, COMPARED)
