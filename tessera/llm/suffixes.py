"""Removal of long repeated substrings, by suffix arrays over the places that can repeat.

A string can only repeat where its smallest K-byte gram does (winnowing: the gram and its place depend on the string
alone). So each run of windows with one smallest gram, its anchor, gives one context: the bytes of those windows.
Anchors are those of windows of the shortest length asked for; a longer window goes by the anchor of its beginning.

Windows that are equal have their anchor at one place. Those whose anchor stands in their first half all hold the bytes to
its right, those of the other half those to its left. So each context is two parts, and each part has a core. By hashes
of both, before any bytes move: equal parts repeat, and a part whose core no other part has does not. Different parts with
one core are brought together, and a suffix array of each shard tells which of their windows repeat: suffixes
smaller than their successors are sorted directly, the others are induced by scanning buckets by first byte, and
adjacent common prefixes of a whole window are repeats. Where more parts share a core than a shard takes, the places of
the anchor are halved, for each length by itself: the cores get longer, equal pieces are counted, pieces with a core of
their own are done, and what is left is halved again. At one place the core is the window itself. So a group of any size
is split, and each row goes on only with what is still open.

Texts are UTF-8 bytes. Cases: null and empty texts have no bytes; overlapping repeats count, in one text too;
repeated rows are repeats of each other; texts shorter than the length lose nothing; of a very long text only the pieces in
question are moved, and a slice of bytes at a time is read (a text over SLICE comes alone); columns other than doc_id
and text are not looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, sieve, sifted, slices, table, text_bytes, written

LENGTH = 400
#: Bytes of a passage of some fifty words, whose repeats are told beside.
PASSAGE = 256
#: Bytes of the grams that anchor windows.
GRAM = 32
#: Different pieces with one core that share a shard; more are halved first.
SHARD_PIECES = 1000
#: Bytes of contexts that a suffix array is made of at once.
SHARD_BYTES = 1 << 19

#: Bytes of text whose anchors are sought at once.
SLICE = 1 << 19

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    view = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
    h = np.zeros(n, np.uint64)
    for i in range(4):
        h = (h ^ (h >> np.uint64(31))) * _MIX[3] + view[8 * i : 8 * i + n] * _MIX[i]
    h ^= h >> np.uint64(32)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For each run of window starts with one anchor: its row, first and last start, the anchor's place and gram hash."""
    none = np.zeros(0, np.int64)
    if not (np.diff(offsets) >= length).any():
        return none, none, none, none, none
    h = gram_hashes(data)
    width = length - GRAM + 1
    low = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - width + step], low[width - step :])
    place = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    n = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    place = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return row[first], start[first], start[last], place[first], h[place[first]].view(np.int64)


_INT = ("times", "windows", "size", "anchor")
_PLACES = pa.schema([(k, pa.int64()) for k in ("gram", "left_core", "right_core", "left_part", "right_part", "doc_id", "text_hash", "start", "last")] + [(k, pa.int32()) for k in _INT])
PLACES = ", ".join(f"{f.name} {'int' if f.name in _INT else 'bigint'}" for f in _PLACES)


def half(shortest: int) -> int:
    """Bytes before the anchor up to which a window counts by the core to the right."""
    return (shortest - GRAM) // 2


def core_seed(length: int, low: int, high: int) -> int:
    return (length << 40) | (low << 20) | high


def places(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """A row for each anchor: hashes of its gram and of its parts and their cores, where its windows (of the shortest length) start, their number, their bytes to the longest length, and the anchor's place in them.

    Places of a text one after another with equal parts (a text that repeats itself) are one row: `times` of them, from `start` to `last`.
    A part without windows has the hashes 0.
    """
    shortest, longest = min(lengths), max(lengths)
    mid, span = half(shortest), shortest - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_digest

        def hashed(raw: bytes, n: int, some: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[some] = np.frombuffer(b"".join([digest(raw[x:y], s) for x, y, s in zip(begin[some].tolist(), end[some].tolist(), seed[some].tolist(), strict=True)]), "<i8")
            return out

        for batch in batches:
            for b in slices(batch, "text", SLICE):
                data, offsets = text_bytes(b.column(2))
                row, a, z, p, gram = anchors(data, offsets, shortest)
                n, raw, end = len(a), data.tobytes(), offsets[row + 1]
                right, left = p - z <= mid, p - a > mid
                begin, until = np.maximum(a, p - mid), np.minimum(z, p - mid - 1)  # first window of the right part, last one of the left
                fixed = lambda low, high: np.full(n, core_seed(shortest, low, high))
                places = lambda lead, windows: (lead << 20) | windows
                hashes = {
                    "gram": gram,
                    "left_core": hashed(raw, n, left, p - mid - 1, p - span + shortest, fixed(mid + 1, span)),
                    "right_core": hashed(raw, n, right, p, p - mid + shortest, fixed(0, mid)),
                    "left_part": hashed(raw, n, left, a, np.minimum(until + longest, end), places(p - a, until - a)),
                    "right_part": hashed(raw, n, right, begin, np.minimum(z + longest, end), places(p - begin, z - begin)),
                }
                new = np.ones(n, bool)
                new[1:] = (row[1:] != row[:-1]) | np.any([x[1:] != x[:-1] for x in hashes.values()], axis=0)
                first = np.flatnonzero(new)
                closing = np.append(first[1:], n) - 1 if n else first
                last = (a - offsets[row])[closing]
                ints = {"times": closing - first + 1, "windows": (z - a + 1)[first], "size": (np.minimum(z + longest, end) - a)[first], "anchor": (p - a)[first]}
                row = row[first]
                ids, texts = (b.column(i).take(pa.array(row)) for i in (0, 1))
                yield table({k: x[first] for k, x in hashes.items()} | {"doc_id": ids, "text_hash": texts, "start": a[first] - offsets[row], "last": last} | {k: x.astype(np.int32) for k, x in ints.items()}, _PLACES)

    return arrow_stage(rows_of(docs), run, PLACES)


def sides(placed: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The parts of places, a row each: low and high (bytes before the anchor), core, part, times, where its first window starts, there and at the last time, its windows, bytes, and lead: bytes before the anchor in the first window."""
    shortest, longest = min(lengths), max(lengths)
    mid, span = half(shortest), shortest - GRAM
    ahead = F.greatest(F.lit(0), F.col("anchor") - mid)  # windows of the left part
    after = F.least(F.col("windows"), ahead)
    at = lambda low, high, side, skip, windows, size: F.struct(
        F.lit(low).alias("low"), F.lit(high).alias("high"), F.col(f"{side}_core").alias("core"), F.col(f"{side}_part").alias("part"), "times",
        (F.col("start") + skip).alias("start"), (F.col("last") + skip).alias("last"), windows.cast("int").alias("windows"), size.cast("int").alias("size"), (F.col("anchor") - skip).cast("int").alias("lead"))
    left = at(mid + 1, span, "left", F.lit(0), after, F.least(F.col("size"), after - 1 + longest))
    right = at(0, mid, "right", ahead, F.col("windows") - ahead, F.col("size") - ahead)
    both = F.filter(F.array(left, right), lambda x: x["windows"] > 0)
    return placed.select("doc_id", "text_hash", F.inline(both))


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor: the byte after a run of equal ones is larger; at the end it is not."""
    n = len(text)
    change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
    end = change[np.searchsorted(change, np.arange(n))]
    smaller = np.zeros(n, bool)
    some = end < n - 1
    smaller[some] = text[end[some] + 1] > text[end[some]]
    return smaller


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of `text` (bytes) in order of their first `depth` symbols at least; equal ones in any order.

    Two stages: only suffixes smaller than their successors are sorted directly; those not smaller are induced from
    their successors by a scan of the buckets of the first byte, in order. `wanted` leaves out what isn't asked for:
    besides, only suffixes up to the first directly sorted one after a wanted one take part.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    smaller = smaller_than_next(text)
    part = np.ones(n, bool)
    if wanted is not None:
        places = np.append(np.flatnonzero(smaller), n - 1)
        last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))  # a run of wanted ones ends here
        until = places[np.searchsorted(places, last)]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, last, 1)
        np.add.at(edge, until + 1, -1)
        part = wanted | (np.cumsum(edge[:-1]) > 0)
    direct = np.flatnonzero(smaller & part)
    direct = direct[_order(text, direct, depth)]
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if part[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))
    follows = part & ~smaller  # to be induced
    out = [np.zeros(0, np.int64)]
    for byte in range(256):
        own = induced[byte]
        while own:  # suffixes that begin with a run of this byte come one after another
            front = np.concatenate(own)
            out.append(front)
            own = _induce(text, follows, front, byte, induced)
        rest = direct[bounds[byte] : bounds[byte + 1]]
        if len(rest):
            out.append(rest)
            _induce(text, follows, rest, byte, induced)
    return np.concatenate(out)


def _induce(text: np.ndarray, follows: np.ndarray, front: np.ndarray, byte: int, induced: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Put the predecessors that are to be induced into their buckets; those in this very bucket are returned."""
    before = front[front > 0] - 1
    before = before[follows[before]]
    first = text[before]
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    cuts = np.append(np.flatnonzero(np.append(True, first[1:] != first[:-1])), len(first)) if len(first) else []
    same = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        (same if first[i] == byte else induced[first[i]]).append(before[i:j])
    return same


def _order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes at `at` by `depth` bytes. Ties alone go on, 8 bytes at a time."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    keys = np.ndarray(len(text) + 8, ">u8", padded.tobytes(), strides=(1,))
    order = np.argsort(keys[at], kind="stable")
    key = keys[at[order]]
    tied = np.append(False, key[1:] == key[:-1])
    skip = 8
    while skip < depth and tied.any():
        # groups of ties: a row that equals the one before, and the row before it
        where = np.flatnonzero(tied | np.append(tied[1:], False))
        group = np.cumsum(~tied[where]) - 1
        mine = order[where]
        place = at[mine] + skip
        key = np.where(place < len(text), keys[np.minimum(place, len(text))], np.uint64(0))
        differ = np.append(False, (key[1:] != key[:-1]) & (group[1:] == group[:-1]))
        split = np.flatnonzero((np.bincount(group[differ], minlength=group[-1] + 1) > 0)[group])  # other groups stay as they are
        if len(split):
            by = split[np.lexsort((key[split], group[split]))]
            order[where[split]], key[split] = mine[by], key[by]
            tied[where] = np.append(False, (key[1:] == key[:-1]) & (group[1:] == group[:-1]))
        skip += 8
    return order


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a[i] and b[i] share their first `length` bytes."""
    keys = np.ndarray(len(text) + 8, "<u8", np.concatenate([text, np.zeros(16, np.uint8)]).tobytes(), strides=(1,))
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    for skip in [*range(0, length - 7, 8), max(0, length - 8)]:
        live = live[keys[a[live] + skip] == keys[b[live] + skip]]
        if not len(live):
            break
    out[:] = False
    out[live] = True
    return out


def repeated_windows(parts: list[bytes], windows: np.ndarray, lengths: tuple[int, ...]) -> dict[int, list[np.ndarray]]:
    """For each length and part, which of its windows begin a string of that length that some other window begins too."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(x) for x in parts])
    offset = np.cumsum(sizes) - sizes
    left = np.zeros(len(text), np.int64)  # bytes to the part's end, at its windows
    for o, w, n in zip(offset.tolist(), windows.tolist(), sizes.tolist(), strict=True):
        left[o : o + w] = np.arange(n, n - w, -1)
    order = suffix_array(text, max(lengths), left > 0)
    out = {}
    for length in lengths:
        own = order[left[order] >= length]
        hit = np.zeros(len(text), bool)
        if len(own) > 1:
            same = common(text, own[:-1], own[1:], length)
            hit[own[1:][same]] = True
            hit[own[:-1][same]] = True
        out[length] = [hit[o : o + w] for o, w in zip(offset.tolist(), windows.tolist(), strict=True)]
    return out


def ranges(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


#: Windows of a part whose anchor has `low` to `high` bytes before it, with the hash of what they all hold and of all their bytes.
#: length 0: windows of every length. `of_low`, `of_core` and `part` name the part, `shift` is the first window's place in it.
_PIECES = pa.schema([("length", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("core", pa.int64()), ("piece", pa.int64()), ("single", pa.bool_()), ("of_low", pa.int32()), ("of_core", pa.int64()), ("part", pa.int64()), ("shift", pa.int32()), ("windows", pa.int32()), ("lead", pa.int32()), ("bytes", pa.binary())])
PIECES = "length int, low int, high int, core bigint, piece bigint, single boolean, of_low int, of_core bigint, part bigint, shift int, windows int, lead int, bytes binary"
CORE = ["length", "low", "core"]
PART = ["of_low", "of_core", "part"]


def piece(text: bytes, anchor: int, length: int, low: int, high: int, most: int, least: int) -> tuple[int, int, int, bytes] | None:
    """Of text's windows whose anchor has `least` to `most` bytes before it those of `low` to `high`: core, piece, most, bytes."""
    most, least = min(most, high), max(least, low, anchor + length - len(text))
    if least > most:
        return None
    core = xxhash.xxh3_64_intdigest(text[anchor - low : anchor - high + length], core_seed(length, low, high))
    own = text[anchor - most : anchor - least + length]
    return _signed(core), _signed(xxhash.xxh3_64_intdigest(own, (most << 20) | (most - least))), most, own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += len(r[-1]) + 100
        if size > SHARD_BYTES:
            yield table(dict(zip(_PIECES.names, map(list, zip(*held, strict=True)), strict=True)), _PIECES)
            held, size = [], 0
    if held:
        yield table(dict(zip(_PIECES.names, map(list, zip(*held, strict=True)), strict=True)), _PIECES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the parts asked for, to those parts' bytes."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for text, wanted in zip(batch.column(0).cast(pa.large_binary()), batch.column(1), strict=True):
                raw = text.as_py()
                for x in wanted.as_py():
                    yield 0, x["low"], x["high"], x["core"], x["part"], x["single"], x["low"], x["core"], x["part"], 0, x["windows"], x["lead"], raw[x["start"] : x["start"] + x["size"]]

    return _batches(rows())


def _halved(lengths: tuple[int, ...]):
    """Each piece as two for each length, by the bytes before the anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for x in b.to_pylist():
                mid = (x["low"] + x["high"]) // 2
                for length in (x["length"],) if x["length"] else lengths:
                    for low, high in ((x["low"], mid), (mid + 1, x["high"])):
                        if got := piece(x["bytes"], x["lead"], length, low, high, x["lead"], x["lead"] - x["windows"] + 1):
                            core, name, most, own = got
                            yield length, low, high, core, name, x["single"], x["of_low"], x["of_core"], x["part"], x["shift"] + x["lead"] - most, len(own) - length + 1, most, own

    return lambda batches: _batches(rows(batches))


_HITS = pa.schema([("of_low", pa.int32()), ("of_core", pa.int64()), ("part", pa.int64()), ("length", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])
HITS = "of_low int, of_core bigint, part bigint, length int, a int, b int"


def _shards(lengths: tuple[int, ...]):
    """Pieces sorted by core, to the repeated windows of those that occur once. Cores stay whole within a shard."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        out: list[tuple] = []
        for kind in {x["length"] for x in rows}:
            own = [x for x in rows if x["length"] == kind]
            for length, hits in repeated_windows([x["bytes"] for x in own], np.array([x["windows"] for x in own]), (kind,) if kind else lengths).items():
                out += [(*(x[k] for k in PART), length, x["shift"] + r["a"], x["shift"] + r["b"]) for x, hit in zip(own, hits, strict=True) if x["single"] for r in ranges(hit)]
        return table(dict(zip(_HITS.names, map(list, zip(*out, strict=True)), strict=True)) if out else {k: [] for k in _HITS.names}, _HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for x in batch.to_pylist():
                if size > SHARD_BYTES and any(x[k] != held[-1][k] for k in CORE):
                    yield solve(held)
                    held, size = [], 0
                held.append(x)
                size += len(x["bytes"])
        if held:
            yield solve(held)

    return run


def settled(pieces: DataFrame, members: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """The repeated windows (from a to before b) of parts that occur once. pieces: different ones only; members: how many have each core."""
    found = []
    while True:
        few, many = (pieces.join(members.where(which).select(*CORE), CORE) for which in (F.col("members") <= SHARD_PIECES, F.col("members") > SHARD_PIECES))
        found.append(arrow_stage(few.repartition(*CORE).sortWithinPartitions(*CORE).select(*_PIECES.names), _shards(lengths), HITS))
        if members.where(F.col("members") > SHARD_PIECES).isEmpty():
            return reduce(DataFrame.unionByName, found)
        halves = written(arrow_stage(many.select(*_PIECES.names), _halved(lengths), PIECES), "halves")
        distinct = halves.groupBy(*CORE, "piece").agg(((F.count(F.lit(1)) == 1) & F.bool_and("single")).alias("alone"), F.min(F.struct(*PART)).alias("first"))
        distinct = written(distinct, "distinct")
        again = distinct.where("not alone").select(*CORE, "piece")
        found.append(halves.where("single").join(again, [*CORE, "piece"]).select(*PART, "length", F.col("shift").alias("a"), (F.col("shift") + F.col("windows")).alias("b")))
        members = distinct.groupBy(*CORE).agg(F.count(F.lit(1)).alias("members"), F.bool_or("alone").alias("open")).where("members > 1 and open").select(*CORE, "members")
        members = written(members, "members")
        on = distinct.join(members.select(*CORE), CORE).select(*CORE, "piece", "alone", "first.*")  # one of each different piece goes on
        pieces = written(halves.join(on, [*CORE, "piece", *PART]).withColumn("single", F.col("alone")).select(*_PIECES.names), "pieces")


def repeats(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """doc_id, text_hash, spans: for each text with repeated strings of a length, that and the byte ranges that they cover (may overlap)."""
    docs = rows_of(docs)
    placed = written(places(docs, lengths), "places")
    # what hot keys are joined to is written first, so that the engine can split their rows
    grams = written(placed.groupBy("gram").agg(F.sum("times").alias("n")).where("n > 1").select("gram"), "grams")
    parts = written(sides(placed.join(grams, "gram"), lengths), "parts")
    key = ["low", "core", "part"]
    at = F.min(F.struct("doc_id", "text_hash", "start", "high", "windows", "size", "lead"))
    distinct = written(parts.groupBy(*key).agg((F.sum("times") == 1).alias("single"), at.alias("at")), "distinct")
    members = distinct.groupBy("low", "core").agg(F.count(F.lit(1)).alias("members"), F.bool_or("single").alias("open")).where("members > 1 and open")
    members = written(members.select(F.lit(0).alias("length"), "low", "core", "members"), "members")
    wanted = distinct.join(members.select("low", "core"), ["low", "core"]).groupBy(F.col("at.doc_id").alias("_doc"), F.col("at.text_hash").alias("_hash"))
    wanted = written(wanted.agg(F.collect_list(F.struct(*key, "single", "at.start", "at.high", "at.windows", "at.size", "at.lead")).alias("wanted")), "wanted")
    may_be = sieve(wanted, "_hash")
    cut = sifted(docs, "text_hash", may_be).join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).select("text", "wanted")
    # a row that repeats gives its pieces again; the second is not needed
    pieces = written(arrow_stage(cut, _cut, PIECES), "pieces").dropDuplicates([*CORE, "piece"])
    hits = settled(pieces, members, lengths).groupBy(*PART).agg(F.collect_list(F.struct("length", "a", "b")).alias("ranges"))
    n_of = lambda length: F.least(F.col("at.windows"), F.col("at.size") - length + 1)
    whole = F.filter(F.array(*[F.struct(F.lit(x).alias("length"), F.lit(0).alias("a"), n_of(x).alias("b")) for x in lengths]), lambda r: r["b"] > 0)
    found = distinct.where("not single").select(*key, whole.alias("ranges")).unionByName(hits.select(F.col("of_low").alias("low"), F.col("of_core").alias("core"), "part", "ranges"))
    spans = parts.join(written(found, "found"), key).select("doc_id", "text_hash", F.inline(F.transform("ranges", lambda r: F.struct(r["length"].alias("length"), (F.col("start") + r["a"]).alias("a"), (F.col("last") + r["b"] - 1 + r["length"]).alias("b")))))
    return written(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("length", "a", "b")).alias("spans")), "spans")


def covered(n: int, spans: list[dict]) -> np.ndarray:
    """Which of n bytes some span covers."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, [x["a"] for x in spans], 1)
    np.add.at(edge, [x["b"] for x in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def without_spans(text: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes that go, and the number of maximal runs of them."""
    if not spans:
        return text, 0, 0
    gone = covered(len(text), spans)
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, len(text) - len(kept), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and the spans of each row (null: none). Most rows without any are not shuffled."""
    docs, may_be = rows_of(docs), sieve(spans, "text_hash")
    s = spans.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "spans")
    joined = sifted(docs, "text_hash", may_be).join(s, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left").select("doc_id", "text", "spans")
    rest = sifted(docs, "text_hash", may_be, False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return joined.unionByName(rest)
