"""Compression of vectors to codes: a codebook for each of their parts, fitted by Lloyd's rounds with Yinyang bounds.

Components become whole numbers, floor(1024 x), and all that decides is whole-number arithmetic. A codebook's entries are
put in groups of neighbours. The state of a vector's part is its entry, an upper bound of the distance to it, and for each
group a lower bound of the distance to the group's other entries. When entries move, the bounds drift by the entry's and
by the group's largest move. Where every group's bound stays above the upper bound the assignment stands without a look
at the entries; else the upper bound is made exact and only the groups whose bound still fails are scanned. Distances are
first computed in doubles with an error bound; entries that this leaves tied are compared as whole numbers, and the lower
index wins. Bounds are kept in single precision, rounded to the safe side.

A round reads the state, a written table, and writes the next; entries are replaced from sums of the parts that moved,
which each task adds up first. The driver has the codebooks and those sums, parts x entries x their components, whatever the rows.

Cases: rows go whose vector is null, holds a null or non-finite component or one of 2^27/1024 and more in size (so that
sums of squares stay whole numbers in a long), or has another length than the one with the smallest vec_id (nulls last, then
by the vector); a length that 4 doesn't divide gives shorter last parts; fewer vectors than entries make fewer entries;
repeated rows and ids each have their row; other columns are not looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, dropped, n_written, table, written, written_since

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Entries to a group, about.
GROUP = 16
#: Components at or beyond this are out of range.
LARGEST = 1 << 27
#: Vectors that are compared at once.
ROWS = 2048

STATE = "vec_id bigint, label string, v array<int>, code array<smallint>, before array<smallint>, upper array<float>, lower array<float>"
_STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int32())), ("code", pa.list_(pa.int16())), ("before", pa.list_(pa.int16())), ("upper", pa.list_(pa.float32())), ("lower", pa.list_(pa.float32()))])


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: the vectors that are kept, as whole numbers."""
    x = F.col("embedding")
    v = F.transform(x, lambda c: F.floor(c.cast("double") * 1024))
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / 1024))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint"), F.col("label").cast("string"), v.cast("array<int>").alias("v"))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v")).head()
    return kept.where(F.size("v") == (first[0] if first else 0))


def bounds(d: int, parts: int = PARTS) -> list[slice]:
    """Where the parts of a vector of d components lie."""
    step = -(-d // parts)
    return [slice(min(i * step, d), min((i + 1) * step, d)) for i in range(parts)]


def grouped(c: np.ndarray, size: int = GROUP) -> np.ndarray:
    """A group for each entry: some rounds of Lloyd over the entries themselves, from entries far from each other."""
    g, x = max(1, len(c) // size), c.astype(float)
    far, chosen = ((x - x[0]) ** 2).sum(axis=1), [0]
    for _ in range(g - 1):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centre = x[chosen]
    for _ in range(5):
        of = ((x[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        centre = np.stack([x[of == i].mean(axis=0) if (of == i).any() else centre[i] for i in range(g)])
    return np.unique(of, return_inverse=True)[1].ravel()


@dataclass
class Codebook:
    """One part's entries (whole numbers), their groups, and how far each has moved since the assignment before (None: there was none)."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray | None = None

    def __post_init__(self):
        self.order = np.argsort(self.group, kind="stable")  # columns: groups one after another
        self.first = np.searchsorted(self.group[self.order], np.arange(self.n_groups + 1))
        self.column = np.argsort(self.order)

    @property
    def n_groups(self) -> int:
        return int(self.group.max()) + 1


def _low(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def _high(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, as whole numbers."""
    return ((x - c) ** 2).sum(axis=-1)


def assign(x: np.ndarray, book: Codebook, code: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row (lower index on ties), its bounds, and how many distances were computed. Without code and bounds: from nothing."""
    n, g = len(x), book.n_groups
    count = 0
    if code is None:
        scan = np.ones((n, g), bool)
        rows, old = np.arange(n), np.full(n, -1)
        code, upper, lower = np.zeros(n, np.int64), np.zeros(n, np.float32), np.zeros((n, g), np.float32)
    else:
        most = np.zeros(g)
        np.maximum.at(most, book.group, book.moved)
        upper = _high(upper.astype(float) + book.moved[code])
        lower = _low(lower.astype(float) - most)
        rows = np.flatnonzero(lower.min(axis=1) <= upper)
        d = exact(x[rows], book.entries[code[rows]])
        count += len(rows)
        upper[rows] = _high(np.sqrt(d.astype(float)))
        scan = lower[rows] <= upper[rows, None]
        rows, scan = rows[scan.any(axis=1)], scan[scan.any(axis=1)]
        old = code[rows]
    c = book.entries[book.order]
    cf, code, upper, lower = c.astype(float), code.copy(), upper.copy(), lower.copy()
    for at in range(0, len(rows), ROWS):
        r, s, was = rows[at : at + ROWS], scan[at : at + ROWS], old[at : at + ROWS]
        y = x[r]
        yf = y.astype(float)
        yy, cc = (yf**2).sum(axis=1), (cf**2).sum(axis=1)
        open_ = np.repeat(s, np.diff(book.first), axis=1)
        d = np.where(open_, yy[:, None] - 2 * (yf @ cf.T) + cc[None, :], np.inf)  # one product for all groups is cheaper than one for each
        count += int(open_.sum())
        known = was >= 0
        if known.any():
            d[np.flatnonzero(known), book.column[was[known]]] = exact(y[known], book.entries[was[known]])
        error = (np.sqrt(yy) + np.sqrt(cc.max())) ** 2 * (2.0**-50 * (y.shape[1] + 4)) + 0.25
        close = d <= (d.min(axis=1) + 2 * error)[:, None]
        tied = np.flatnonzero(close.sum(axis=1) > 1)
        best = book.order[d.argmin(axis=1)]
        if len(tied):
            i, j = np.nonzero(close[tied])
            entry = book.order[j]
            by = np.lexsort((entry, exact(y[tied[i]], book.entries[entry]), i))
            first = by[np.searchsorted(i[by], np.arange(len(tied)))]
            best[tied] = entry[first]
        code[r] = best
        upper[r] = _high(np.sqrt(exact(y, book.entries[best]).astype(float)))
        mine = np.arange(len(r)), book.column[best]
        d[mine] = np.inf
        near = np.minimum.reduceat(d, book.first[:-1], axis=1)  # no group is empty
        near = _low(np.sqrt(np.maximum(near - error[:, None], 0)))
        # of a group that wasn't scanned only the entry before may be seen, which the bound left out
        lower[r] = np.where(s, near, np.minimum(lower[r], near))
    return code, upper, lower, count


def _matrix(column: pa.Array, n: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel(), kind))


def step(state: DataFrame, books: list[Codebook], d: int, begin: bool) -> DataFrame:
    """The state after all parts are assigned anew."""
    shared, at = state.sparkSession.sparkContext.broadcast(books), bounds(d)  # parts x entries x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cuts = np.cumsum([0, *(b.n_groups for b in own)])
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = _matrix(b.column(2), n, np.int64)
            if begin:
                found, before = [assign(v[:, s], book) for s, book in zip(at, own, strict=True)], np.full((n, PARTS), -1)
            else:
                before, upper, lower = _matrix(b.column(3), n, np.int64), _matrix(b.column(5), n, np.float32), _matrix(b.column(6), n, np.float32)
                found = [assign(v[:, s], book, before[:, p], upper[:, p], lower[:, cuts[p] : cuts[p + 1]]) for p, (s, book) in enumerate(zip(at, own, strict=True))]
            code, upper = (np.stack([f[i] for f in found], axis=1) for i in (0, 1))
            yield table({"vec_id": b.column(0), "label": b.column(1), "v": b.column(2), "code": _lists(code, pa.int16()), "before": _lists(before, pa.int16()), "upper": _lists(upper, pa.float32()), "lower": _lists(np.concatenate([f[2] for f in found], axis=1), pa.float32())}, _STATE)

    return written(arrow_stage(state, run, STATE), "codes")


def moves(state: DataFrame, d: int) -> DataFrame:
    """part, entry, place, n: what the parts that moved add to the number of an entry's parts (at place 0) and to the sums of their components (the last at -1, the one before at -2, ...)."""
    at, schema = bounds(d), pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-d // PARTS) + 1
        sums = np.zeros((PARTS, ENTRIES, width), np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v, code, before = (_matrix(b.column(i), n, np.int64) for i in (0, 1, 2))
            for p, s in enumerate(at):
                for who, sign in ((code[:, p], 1), (before[:, p], -1)):
                    own = np.flatnonzero((code[:, p] != before[:, p]) & (who >= 0))
                    x = np.concatenate([v[own, s], np.ones((len(own), 1), np.int64)], axis=1)
                    np.add.at(sums[p][:, -x.shape[1] :], who[own], sign * x)
        i, j, k = np.nonzero(sums)
        yield table({"part": i, "entry": j, "place": k - (width - 1), "n": sums[i, j, k]}, schema)

    changed = state.where(F.col("code") != F.col("before")).select("v", "code", "before")
    return arrow_stage(changed, run, "part int, entry int, place int, n bigint").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """The codebooks of a table of vectors, by part: entries as whole numbers."""

    d: int
    entries: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def fitted(vectors: DataFrame, rounds: int = ROUNDS, size: int = GROUP) -> tuple[Model, DataFrame]:
    """The codebooks after so many rounds, and the state (STATE) of all vectors assigned to them."""
    spark = vectors.sparkSession
    begun = n_written(spark)
    kept = written(whole(vectors), "vectors")
    start = [r.v for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()]
    empty = lambda c, kind: F.expr(f"cast(null as {kind})").alias(c)
    state = kept.select("vec_id", "label", "v", empty("code", "array<smallint>"), empty("before", "array<smallint>"), empty("upper", "array<float>"), empty("lower", "array<float>"))
    d = len(start[0]) if start else 0
    if not start:
        return Model(0, [np.zeros((0, 0), np.int64)] * PARTS), state
    entries = np.array(start, np.int64)
    books = [Codebook(entries[:, s], grouped(entries[:, s], size)) for s in bounds(d)]
    sums = [np.zeros((len(entries), b.entries.shape[1] + 1), np.int64) for b in books]
    state = step(state, books, d, True)
    dropped(spark, written_since(spark, begun), (state,))
    for _ in range(rounds):
        for r in moves(state, d).collect():  # bounded: parts x entries x components
            sums[r.part][r.entry, r.place - 1] += r.n
        new = []
        for b, s in zip(books, sums, strict=True):
            n = s[:, -1]
            to = np.where(n[:, None] > 0, s[:, :-1] // np.maximum(n, 1)[:, None], b.entries)
            moved = np.sqrt(exact(to, b.entries).astype(float)) * (1 + 2.0**-40)
            new.append(Codebook(to, b.group, moved))
        books = new
        if not any(b.moved.any() for b in books):
            break  # nothing will change any more
        state = step(state, books, d, False)
        dropped(spark, written_since(spark, begun), (state,))
    return Model(d, [b.entries for b in books]), state


def coded(model: Model, state: DataFrame) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error: the squared distance to the entries, summed over parts."""
    shared, at = state.sparkSession.sparkContext.broadcast(model.entries), bounds(model.d)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                v, code = _matrix(b.column(2), n, np.int64), _matrix(b.column(3), n, np.int64)
                error = sum(exact(v[:, s], e[code[:, p]]) for p, (s, e) in enumerate(zip(at, shared.value, strict=True)))
                yield table({"vec_id": b.column(0), "label": b.column(1), "code": [bytes(x).hex() for x in code.astype(np.uint8)], "error": error}, schema)

    return arrow_stage(state.select("vec_id", "label", "v", "code"), run, "vec_id bigint, label string, code string, error bigint")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each vector that is kept."""
    model, state = fitted(vectors)
    each = written(coded(model, state), "coded")
    sums = each.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = written(sums, "label-errors")  # a label may have a large part of all rows: the engine splits the rows that meet its sum
    out = each.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
