"""SimHash fingerprints and the groups of near duplicates among them.

Two fingerprints at most RADIUS = 4 bits apart agree in b - 4 of b bands, so pairs are sought among fingerprints
that share b - 4 bands, for every choice of bands. Within such a bucket distances are counted bit-sliced: bit
planes stand vertically, 64 fingerprints to a word, three carry-save counters add up the differing planes of
all lanes at once, and a comparison ends when every lane of it is beyond the radius. A bucket gives a spanning
forest of its links, not its pairs; buckets over BUCKET fingerprints are dealt out as pairs of chunks.

Texts of a given resemblance (Jaccard of their distinct shingles) may be further apart. `alike` links them exactly, in
two steps. First it compares fingerprints that share sampled bits, up to WIDE_RADIUS; this finds most links of large
groups as a forest. Then two texts not yet together that share enough of their rarest shingles (prefix filter: a pair alike
enough must share one, and as many more as both prefixes are longer than for one) are compared by length and marks. Prefixes travel packed, a block of texts to each
part of the hashes, and only shingles that different texts share become rows. Marks are parities of MARK_BITS classes of
shingles: as many as differ, so many shingles at least differ, so no filter loses a pair. What is left is decided by the
texts' sets of shingles themselves. Nothing depends on how many texts there are but the number of parts.

Words: runs of bytes other than [space, \\t-\\r], A-Z lower-cased; shingles of `size` words, repeats included; a shorter
text is one shingle. Cases: very long texts are read whole, a slice of bytes at a time (a text over SLICE_BYTES comes
alone), and columns other than doc_id and text are not looked at, whatever they are called; a text without words (or null) has fingerprint zero and is linked as any other;
equal fingerprints are one group; rows without doc_id take part but name no group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, dropped, n_written, runs, sieve, sifted, slices, table, text_bytes, written, written_since
from tessera.operators.algorithms import together

RADIUS = 4
#: Fingerprints in a chunk of a large bucket; a task compares two chunks at a time.
BUCKET = 4096

#: Classes of shingles in a text's mark.
MARK_BITS = 1024
#: The same folded, for the comparison of fingerprints.
SHORT_BITS = 512
#: Of a text's distinct shingles, the share that its prefix is longer by; two texts must share so many of the shorter one's, and one, in their prefixes.
LONGER = 0.02
#: Prefix shingles that a task packs at once, and that a part is meant to hold.
PACK, PART = 1 << 21, 1 << 20
#: Bits apart up to which fingerprints are compared first, and the sampled tables for that. What they miss the prefixes find.
WIDE_RADIUS, TABLES = 14, 8
#: Texts whose shingles are counted to order all by frequency, and shingles of which the count is kept. Any order is exact.
SAMPLE, COMMON = 4096, 1 << 16
_MIX = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the shingles of all rows, big-endian, and the number of shingles before each row, with the end."""
    data, offsets = text_bytes(column)
    low, inside = _LOWER[data], _INSIDE[data]
    starts, ends, before = runs(data, inside, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    gaps = ends[ends < offsets[row + 1]]  # one space is left between words
    low[gaps] = 32
    inside[gaps] = True
    place = np.cumsum(inside)
    packed = low[inside].tobytes()
    n_words = np.diff(before)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    upto = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=upto[1:])
    first = np.repeat(before[:-1] - upto[:-1], n) + np.arange(upto[-1])
    final = np.minimum(first + size, np.repeat(before[1:], n)) - 1
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(packed[a:b], 42) for a, b in zip((place[starts[first]] - 1).tolist(), place[ends[final] - 1].tolist(), strict=True)])
    return np.frombuffer(hashes, ">u8"), upto


def simhash(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each row, the bits set in more than half of its hashes."""
    out = np.zeros(len(upto) - 1, np.uint64)
    some = np.flatnonzero(np.diff(upto))
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, upto[some], axis=0, dtype=np.int64)
        most = counts * 2 > np.diff(upto)[some, None]
        out[some] = np.packbits(most, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint of every whole text, as the signed value of its bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                yield table({"doc_id": b.column(0), "text_hash": b.column(1), "fp": simhash(*shingle_hashes(b.column(2), size)).view(np.int64)}, schema)

    return arrow_stage(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id bigint, text_hash bigint, fp bigint")


def marked(docs: DataFrame, size: int) -> DataFrame:
    """fingerprints with node, a hash of the set of n distinct shingles, its mark and that one folded."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("short", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                hashes, upto = shingle_hashes(b.column(2), size)
                sets = distinct_hashes(hashes, upto)
                full = marks(*sets)
                short = np.concatenate([full[:, :1], np.bitwise_xor.reduce(full[:, 1:].reshape(len(full), -1, SHORT_BITS // 64), axis=1)], axis=1)
                yield table({"doc_id": b.column(0), "text_hash": b.column(1), "fp": simhash(hashes, upto).view(np.int64), "node": set_names(*sets), "n": np.diff(sets[1]), "mark": [x.tobytes() for x in full], "short": [x.tobytes() for x in short]}, schema)

    return arrow_stage(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id bigint, text_hash bigint, fp bigint, node bigint, n bigint, mark binary, short binary")


def distinct_hashes(hashes: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row, ascending, and their number before each row, with the end."""
    h, row = hashes.astype(np.uint64), np.repeat(np.arange(len(upto) - 1), np.diff(upto))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(upto)))


def set_names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)


def marks(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the size of its set and the parities of its MARK_BITS classes, as words of 64 bits."""
    n = len(at) - 1
    out = np.zeros((n, 1 + MARK_BITS // 64), np.uint64)
    out[:, 0] = np.diff(at)
    of = (((h * _MIX) >> np.uint64(32)) % np.uint64(MARK_BITS)).astype(np.int64)
    for i in range(0, n, 1024):
        j = min(n, i + 1024)
        row = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        odd = np.bincount(row * MARK_BITS + of[at[i] : at[j]], minlength=(j - i) * MARK_BITS) & 1
        out[i:j, 1:] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(j - i, -1)
    return out


def may_be_alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Pairs of marks whose sets may have that resemblance; false only where they can't."""
    n, m = a[:, 0].astype(np.int64), b[:, 0].astype(np.int64)
    apart = np.maximum(np.bitwise_count(a[:, 1:] ^ b[:, 1:]).sum(axis=1, dtype=np.int64), np.abs(n - m))
    return apart * (1 + least) <= (n + m) * (1 - least) + 1e-6


def bands(n: int) -> int:
    """Bands that keep buckets of n random fingerprints small; any number from 5 on finds all pairs."""
    return 6 if n < 1 << 22 else 7 if n < 1 << 28 else 8


def bucket_keys(fp: Column, b: int) -> Column:
    """An array of (choice of bands, their bits) of a fingerprint."""
    edges = [round(64 * i / b) for i in range(b + 1)]
    part = [F.shiftrightunsigned(fp, 64 - edges[i + 1]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(b)]
    out = []
    for t, chosen in enumerate(combinations(range(b), b - RADIUS)):
        key = F.lit(0).cast("bigint")
        for i in chosen:
            key = F.shiftleft(key, edges[i + 1] - edges[i]).bitwiseOR(part[i])
        out.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return F.array(*out)


def within(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (bit-sliced, lowest bit first) is at most the radius."""
    more, equal = over, ~over
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal = equal & counters[i]
        else:
            more = more | equal & counters[i]
            equal = equal & ~counters[i]
    return ~more


def links(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, taken: list[np.ndarray] | None = None) -> np.ndarray:
    """For each fingerprint, the place of the first one that it hangs together with inside its bucket. Buckets lie in runs.

    alike: whether two arrays of places are to be linked that are near enough; only pairs not yet together are asked for.
    taken: gets the pairs themselves that brought places together.
    """
    n = len(fp)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)  # rows: fingerprints, columns: planes
    planes = np.ascontiguousarray(np.packbits(bits.reshape(blocks, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, blocks)
    flips = (np.uint64(0) - bits[:n].T.astype(np.uint64)).reshape(64, n)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    stops = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    label, rows, step = np.arange(n), np.arange(n), 0
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(rows := rows[stops[rows] > (rows // 64 + step) * 64]):
        q = rows
        at = q // 64 + step
        lo = np.maximum(q + 1 - at * 64, 0)  # lanes of this bucket after the row itself
        hi = np.minimum(stops[q] - at * 64, 64)
        alive = lo < hi
        q, at, lo, hi = q[alive], at[alive], lo[alive], hi[alive]
        lanes = (full >> (64 - hi).astype(np.uint64)) & (full << lo.astype(np.uint64))
        counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]
        over = np.zeros(len(q), np.uint64)
        for plane in range(64):
            carry = planes[plane, at] ^ flips[plane, q]
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            over |= carry
            if plane % 8 == 7:
                live = (lanes & within(counters, over, radius)) != 0
                if not live.all():
                    q, at, lanes, over = q[live], at[live], lanes[live], over[live]
                    counters = [c[live] for c in counters]
                if not len(q):
                    break
        if len(q):
            near = lanes & within(counters, over, radius)
            for i in range(0, len(q), 1 << 14):
                hit = np.unpackbits(near[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                a, lane = np.nonzero(hit)
                u, v = q[i + a], at[i + a] * 64 + lane
                if alike is not None:
                    apart = label[u] != label[v]
                    u, v = u[apart], v[apart]
                    same = alike(u, v)
                    u, v = u[same], v[same]
                while taken is not None and len(u):  # one pair of each row, then of those still apart
                    first = np.unique(u, return_index=True)[1]
                    taken.append(np.stack([u[first], v[first]], axis=1))
                    _join(label, u[first], v[first])
                    apart = label[u] != label[v]
                    u, v = u[apart], v[apart]
                _join(label, u, v)
        step += 1
    return label


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the groups of a[i] and b[i] in label, which holds each member's smallest."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _edges(radius: int, least: float):
    """Rows of a partition (t, key, a, b, fp, node, mark), sorted by bucket, to the links of each bucket, by node; with `least` pairs that may be alike."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def out(rows: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.append(True, (rows[1:, :4] != rows[:-1, :4]).any(axis=1)))
        crowd = np.bincount(bucket)[bucket] > 1
        bucket, fp, node, marks = bucket[crowd], np.ascontiguousarray(rows[crowd, 4]), rows[crowd, 5], marks[crowd]
        if least:
            taken = [np.zeros((0, 2), np.int64)]
            if len(fp):
                links(fp.view(np.uint64), bucket, radius, lambda u, v: may_be_alike(marks[u], marks[v], least), taken)
            pairs = np.concatenate(taken)
            return table({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]}, schema)
        label = links(fp.view(np.uint64), bucket, radius) if len(fp) else np.zeros(0, np.int64)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return table({"u": node[linked], "v": node[label[linked]]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:6]], axis=1))
            marks.append(np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(b.num_rows, -1) if least else np.zeros((b.num_rows, 0), np.uint64))
            if sum(map(len, held)) >= 4 * BUCKET:
                rows, all_marks = np.concatenate(held), np.concatenate(marks)
                cut = int(np.argmax((rows[:, :4] == rows[-1, :4]).all(axis=1)))  # the last bucket may go on
                held, marks = [rows[cut:]], [all_marks[cut:]]
                if cut:
                    yield out(rows[:cut], all_marks[:cut])
        if held:
            yield out(np.concatenate(held), np.concatenate(marks))

    return run


def _linked(rows: DataFrame, radius: int, least: float) -> DataFrame:
    """u, v: the links in buckets (t, key) of rows with fp, node and mark; large buckets are dealt out as pairs of chunks."""
    half = BUCKET // 2
    large = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("t", "key", F.ceil(F.col("n") / half).cast("int").alias("chunks"))
    dealt = rows.join(large, ["t", "key"], "left")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    # a chunk meets itself and every other one; each pair of chunks is a bucket
    pairs = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"))))
    dealt = dealt.select("t", "key", "fp", "node", "mark", F.inline(pairs))
    ordered = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b").select("t", "key", "a", "b", "fp", "node", "mark")
    return arrow_stage(ordered, _edges(radius, least), "u bigint, v bigint")


def near_pairs(fps: DataFrame) -> DataFrame:
    """u, v: links whose closure holds every two of the distinct fingerprints in column fp that are at most RADIUS bits apart."""
    b = bands(fps.count())
    return _linked(fps.select("fp", F.col("fp").alias("node"), F.lit(None).cast("binary").alias("mark"), F.inline(bucket_keys(F.col("fp"), b))), RADIUS, 0.0)


def sampled_bits(n: int) -> list[list[int]]:
    """TABLES choices of bits such that buckets of n fingerprints stay small."""
    rng = np.random.default_rng(64)
    return [sorted(rng.choice(64, max(12, (n >> 8).bit_length()), replace=False).tolist()) for _ in range(TABLES)]


def close_pairs(nodes: DataFrame, n: int, least: float) -> DataFrame:
    """u, v: links of the n nodes (node, fp, short) that may be alike, among those at most WIDE_RADIUS bits apart that share sampled bits."""
    keys = []
    for t, bits in enumerate(sampled_bits(n)):
        key = F.lit(0).cast("bigint")
        for i in bits:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1)))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
    return _linked(nodes.select("fp", "node", F.col("short").alias("mark"), F.inline(F.array(*keys))), WIDE_RADIUS, least)


def common_shingles(docs: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of shingles that several of some SAMPLE texts have, and in how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                h, at = distinct_hashes(*shingle_hashes(b.column(0), size))
                yield table({"node": np.repeat(set_names(h, at), np.diff(at)), "h": h.view(np.int64)}, pa.schema([("node", pa.int64()), ("h", pa.int64())]))

    texts = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)
    found = arrow_stage(texts, run, "node bigint, h bigint").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def shared(n: np.ndarray) -> np.ndarray:
    """How many shingles texts of n distinct ones must have in common in their prefixes: the least of the two counts."""
    return 1 + np.floor(LONGER * n).astype(np.int64)


def packed_prefixes(docs: DataFrame, size: int, least: float, common: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """part, data: of each text's distinct shingles the rarest, so many that texts of at least that resemblance have shared() in common. A part has the hashes that begin with its bits."""
    schema = pa.schema([("part", pa.int64()), ("data", pa.binary())])
    known, count = (np.append(x, x.dtype.type(0)) for x in common)

    def packed(tokens: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, node = np.concatenate(tokens), np.concatenate(nodes)
        part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        order = np.argsort(part, kind="stable")
        part, short, node = part[order], ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], node[order]
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield table({"part": part[i : i + 1], "data": [short[i:j].tobytes() + node[i:j].tobytes()]}, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, seen, held = [], [], set(), 0
        for batch in batches:
            for b in slices(batch):
                h, at = distinct_hashes(*shingle_hashes(b.column(0), size))
                n, names = np.diff(at), set_names(h, at)
                new = np.zeros(len(n), bool)  # a set that this block has already is left out
                new[np.unique(names, return_index=True)[1]] = True
                new &= np.array([x not in seen for x in names.tolist()], bool)
                seen.update(names[new].tolist())
                row, i = np.repeat(np.arange(len(n)), n), np.searchsorted(known[:-1], h)
                order = np.lexsort((h, np.where(known[i] == h, count[i], 0), row))
                p = np.where(new & (n > 0), n - np.ceil(least * n - 1e-9).astype(np.int64) + shared(n), 0)
                within = np.arange(len(h)) - at[row] < p[row] if len(h) else np.zeros(0, bool)
                tokens.append(h[order][within])
                nodes.append(names[row[within]])
                held += len(tokens[-1])
                if held > PACK:
                    yield from packed(tokens, nodes)
                    tokens, nodes, seen, held = [], [], set(), 0
        if held:
            yield from packed(tokens, nodes)

    return arrow_stage(docs.select("text"), run, "part bigint, data binary")


_SHARED = pa.schema([("token", pa.int64()), ("node", pa.int64())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed prefixes sorted by part, to rows of the tokens that several nodes have."""

    def solve(part: int, packs: list[bytes]) -> pa.RecordBatch:
        sizes = [len(x) // 12 for x in packs]
        token = np.concatenate([np.frombuffer(x, "<u4", n) for x, n in zip(packs, sizes, strict=True)])
        node = np.concatenate([np.frombuffer(x, "<i8", n, 4 * n) for x, n in zip(packs, sizes, strict=True)])
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        again = np.append(False, (token[1:] == token[:-1]) & (node[1:] == node[:-1]))  # from another block
        token, node = token[~again], node[~again]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        several = np.repeat(np.diff(np.append(starts, len(token))) > 1, np.diff(np.append(starts, len(token))))
        return table({"token": (part << 32) + token[several].astype(np.int64), "node": node[several]}, _SHARED)

    held: list[bytes] = []
    part = None
    for b in batches:
        for x, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if held and x != part:
                yield solve(part, held)
                held = []
            part = x
            held.append(data.as_py())
    if held:
        yield solve(part, held)


def _whole(batches: Iterator[pa.RecordBatch], n_keys: int, n_ints: int, rows_at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows in runs that end where one of their buckets (the first n_keys columns) does: the first n_ints columns, and the marks after them if there are any."""
    held: list[np.ndarray] = []
    kept: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns[:n_ints]], axis=1))
        kept.append(np.frombuffer(b"".join(b.column(n_ints).to_pylist()), np.uint64).reshape(b.num_rows, -1) if b.num_columns > n_ints else np.zeros((b.num_rows, 0), np.uint64))
        if sum(map(len, held)) >= rows_at_once:
            rows, more = np.concatenate(held), np.concatenate(kept)
            cut = int(np.argmax((rows[:, :n_keys] == rows[-1, :n_keys]).all(axis=1)))
            held, kept = [rows[cut:]], [more[cut:]]
            if cut:
                yield rows[:cut], more[:cut]
    if held:
        yield np.concatenate(held), np.concatenate(kept)


def _apart(least: float):
    """Rows (token, a, b, n, node, root, mark) sorted by the first four, to pairs of nodes of different roots that may be alike: how many tokens they share here, and must share in all."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("need", pa.int64()), ("have", pa.int64())])

    def pairs(rows: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, node, root = rows[:, 3], rows[:, 4], rows[:, 5]
        need = shared(n)
        starts = np.flatnonzero(np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))
        stops = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
        out, i, step = [np.zeros((0, 3), np.int64)], np.arange(len(rows)), 1
        while len(i := i[i + step < stops[i]]):
            i = i[n[i + step] * least <= n[i] + 1e-6]  # n ascends in a bucket, so none further on is short enough either
            x, y = i, i + step
            some = root[x] != root[y]
            x, y = x[some], y[some]
            same = may_be_alike(mark[x], mark[y], least)
            x, y = x[same], y[same]
            out.append(np.stack([np.maximum(node[x], node[y]), np.minimum(node[x], node[y]), np.minimum(need[x], need[y])], axis=1))
            step += 1
        return np.unique(np.concatenate(out), axis=0, return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, mark in _whole(batches, 3, 6, 4 * BUCKET):
            found, have = pairs(rows, mark)
            u, v, need = np.ascontiguousarray(found.T)
            yield table({"u": u, "v": v, "need": need, "have": have.astype(np.int64)}, schema)

    return run


def prefix_pairs(docs: DataFrame, nodes: DataFrame, n: int, roots: DataFrame, size: int, least: float) -> DataFrame:
    """u, v: all pairs of the n nodes (node, n, mark) of different roots that may be alike. roots: node, root; others are alone."""
    tokens = nodes.agg(F.sum(F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 + F.floor(LONGER * F.col("n")))).head()[0] or 0
    bits = min(32, max(0, int(tokens) // PART).bit_length())
    packed = packed_prefixes(docs, size, least, common_shingles(docs, n, size), bits)
    rows = written(arrow_stage(packed.repartition("part").sortWithinPartitions("part"), _shared, "token bigint, node bigint"), "shared")
    rows = rows.join(nodes.select("node", "n"), "node").join(roots, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"), "n")
    rows = written(rows, "rooted")
    half = BUCKET // 2
    mixed = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    mixed = written(mixed.select("token", F.when(F.col("rows") > BUCKET, F.ceil(F.col("rows") / half).cast("int")).alias("chunks")), "mixed")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    chunks = F.when(F.col("chunks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"))))
    dealt = rows.join(mixed, "token").join(nodes.select("node", "mark"), "node").select("token", "n", "node", "root", "mark", F.inline(chunks))
    ordered = dealt.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "n").select("token", "a", "b", "n", "node", "root", "mark")
    found = arrow_stage(ordered, _apart(least), "u bigint, v bigint, need bigint, have bigint")
    return found.groupBy("u", "v", "need").agg(F.sum("have").alias("have")).where(F.col("have") >= F.greatest(F.col("need") - 1, F.lit(1))).select("u", "v")  # less one, as two hashes of a text may begin alike


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles have at least that resemblance. reps: node and the text_hash of one of its texts."""
    pairs = written(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")
    wanted = written(reps.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node"), "wanted")
    # most texts are in no pair and stay where they are; copies go once
    texts = sifted(docs.select(F.xxhash64("text").alias("text_hash"), "text"), "text_hash", sieve(wanted, "text_hash")).groupBy("text_hash").agg(F.first("text").alias("text"))
    texts = written(texts.join(wanted, "text_hash").select("node", "text"), "texts")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "p"):
                (p, at), (q, to) = (distinct_hashes(*shingle_hashes(b.column(i), size)) for i in (2, 3))
                both = np.array([len(np.intersect1d(p[a:z], q[x:y], assume_unique=True)) for a, z, x, y in zip(at[:-1], at[1:], to[:-1], to[1:], strict=True)], np.int64)
                kept = b.filter(pa.array(both >= least * (np.diff(at) + np.diff(to) - both) - 1e-9))
                yield table({"u": kept.column(0), "v": kept.column(1)}, pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("p")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("q")), "v")
    return written(arrow_stage(both.select("u", "v", "p", "q"), hold, "u bigint, v bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """u, root: the smallest node that each node of the edges hangs together with, by alternating large and small stars."""
    return together(edges, lambda df: written(df, "edges"))


def _rooted(rows: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root, least: each row's group by the links of its node, and the group's smallest doc_id. distinct: node, least."""
    roots = components(edges).withColumnRenamed("u", "node")
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = distinct.join(named, "node")
    group = linked.groupBy("root").agg(F.min("least").alias("group_least"))
    linked = linked.select("node", "root").join(group, "root")
    every = distinct.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("group_least")).alias("least"))
    return rows.join(written(every, "roots"), "node").select("doc_id", "text_hash", "fp", "root", "least")


def grouped(docs: DataFrame, size: int = 4) -> DataFrame:
    """Groups of links of at most RADIUS bits."""
    rows = written(fingerprints(docs, size), "fingerprints").withColumn("node", F.col("fp"))
    distinct = written(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "distinct")
    return _rooted(rows, distinct, near_pairs(distinct.select(F.col("node").alias("fp"))))


def alike(docs: DataFrame, size: int, least: float) -> DataFrame:
    """Groups of links of at least `least` resemblance of the sets of shingles; all of them, and no others."""
    rows = written(marked(docs, size), "fingerprints")
    one = F.first(F.struct("fp", "n", "mark", "short")).alias("one")  # the same of all that have the node, but for fp
    distinct = written(rows.groupBy("node").agg(one, F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least")).select("node", "one.*", "text_hash", "least"), "distinct")
    spark = docs.sparkSession
    n, reps, begun = distinct.count(), distinct.select("node", "text_hash"), n_written(spark)
    first = verified(docs, reps, close_pairs(distinct, n, least), size, least)
    dropped(spark, written_since(spark, begun), (first,))  # links are decided, what led to them can go
    roots = components(first)
    roots = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct()).withColumnRenamed("u", "node")
    rest = verified(docs, reps, prefix_pairs(docs, distinct, n, roots, size, least), size, least)
    dropped(spark, written_since(spark, begun), (first, rest))
    return _rooted(rows.select("doc_id", "text_hash", "fp", "node"), distinct.select("node", "least"), first.unionByName(rest))


def near_duplicates(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of at most RADIUS bits reach."""
    return grouped(docs, size).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def without_near_duplicates(docs: DataFrame, size: int, least: float) -> DataFrame:
    """The rows of docs, all columns, one of each group of texts alike in at least that share of their shingles: that of the smallest doc_id, then of the smallest hash of its text."""
    rows = written(alike(docs, size, least).select("doc_id", "text_hash", "root"), "groups")
    groups = rows.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")).where("rows > 1")
    groups = written(groups.select("root", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")), "firsts")
    may_be = sieve(written(rows.join(groups.select("root"), "root").select("text_hash").distinct(), "grouped"), "text_hash")
    id_, hash_, row_ = "id", "hash", "row"
    every = docs.select(F.col("doc_id").cast("bigint").alias(id_), F.xxhash64("text").alias(hash_), F.struct("*").alias(row_))
    alone = sifted(every, hash_, may_be, False).select("row.*")  # in no group: not shuffled
    crowd = sifted(every, hash_, may_be)
    # of what came through by chance each row is in no group; the others are there if they are the first
    known = rows.join(groups, "root").select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("is_first")).distinct()
    known = written(known, "known")
    joined = crowd.join(known, F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col(hash_) == F.col("text_hash")), "left")
    # rows that repeat are a group, so no other row goes by this
    kept = joined.where("is_first is null or is_first").dropDuplicates([id_, hash_])
    return alone.unionByName(kept.select("row.*"))
