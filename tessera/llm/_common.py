"""What the corpus operators share: Arrow stages, written tables, sieves, words."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow.compute
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.session import shared_dir, ship

#: Bytes of text that a vectorised step takes at once; its temporaries are some 60 times as large.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch between the JVM and Python; a longer row comes alone.
BATCH_BYTES = 4 << 20

_STATE: dict[str, dict] = {}


def worker_state(name: str) -> dict:
    """What a worker keeps under this name between the tasks of stages that ask for it; others let it go."""
    return _STATE.setdefault(name, {})


def begin(keeps: tuple[str, ...]) -> None:
    """At the start of a task: drop what earlier stages kept in this worker."""
    for name, state in _STATE.items():
        if name not in keeps and state:
            state.clear()
            gc.collect()
            give_back()


def give_back() -> None:
    """Return freed memory to the system, as idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


def arrow_stage(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, keeps: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow, with the package at hand on every executor and batches bounded in bytes."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(keeps)
        yield from run(batches)
        give_back()

    return df.mapInArrow(held, schema)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder. This cuts the lineage. It goes when the application ends, or by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _paths(spark).append(path)
    return out


def _paths(spark: SparkSession) -> list[str]:
    """The tables that this application has written and not dropped."""
    sc = spark.sparkContext
    if not hasattr(sc, "_tessera_written"):
        sc._tessera_written = []
    return sc._tessera_written


def n_written(spark: SparkSession) -> int:
    return len(_paths(spark))


def written_since(spark: SparkSession, n: int) -> list[str]:
    return _paths(spark)[n:]


def dropped(spark: SparkSession, tables: list[str], keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete these written tables, but for those that frames in `keep` are or read from."""
    if not tables:
        return
    used = [x for df in keep for x in ([df._tessera_path] if hasattr(df, "_tessera_path") else df.inputFiles())]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in tables:
        if not any(path.rsplit("/", 1)[-1] in x for x in used):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _paths(spark).remove(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `limit` bytes of text; a longer row comes alone."""
    i = batch.schema.get_field_index(column)
    texts = batch.column(i).cast(pa.large_string())
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: none) and the offset at which each row begins, with the end."""
    a = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1 + a.offset)[a.offset :] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which `inside` holds, cut where a row begins; runs before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def table(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)


#: Word bytes after A-Z are lower-cased; 0 elsewhere. Used where a word is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
WORD_BYTES = np.zeros(256, np.uint8)
WORD_BYTES[48:58] = np.arange(48, 58)
WORD_BYTES[97:123] = np.arange(97, 123)
WORD_BYTES[65:91] = np.arange(97, 123)
WORD_BYTES[128:] = np.arange(128, 256)


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all rows, one after another, and the number of words before each row, with the end."""
    data, offsets = text_bytes(column)
    low = WORD_BYTES[data]
    inside = low != 0
    starts, ends, before = runs(data, inside, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[inside])])
    return packed, before


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


#: Bits of a sieve at most: 8 MB, whatever the number of rows.
SIEVE_BITS = 1 << 26


def sieve(rows: DataFrame, column: str) -> tuple[object, int]:
    """A bitmap of the hashes (bigint) in a column, and its number of bits: a hash whose bit isn't set isn't in the column.

    It has SIEVE_BITS at most, so what is sent is bounded; with more rows it lets more through, and nothing else changes.
    """
    spark = rows.sparkSession
    n_bits = min(SIEVE_BITS, 1 << max(15, 3 + rows.count().bit_length()))
    bit = F.pmod(column, F.lit(n_bits)) + 1  # the engine's bitmaps begin at 1
    parts = rows.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bitmap = np.zeros(n_bits // 8, np.uint8)
    for r in parts:
        bitmap[(r.k - 1) * 4096 : r.k * 4096] |= np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(bitmap), n_bits


def sifted(df: DataFrame, column: str, by: tuple[object, int], inside: bool = True) -> DataFrame:
    """The rows of df whose hash may be in the sieve, or the others; nulls are outside."""
    bitmap, n_bits = by
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for b in batches:
            h = pa.compute.fill_null(b.column(place), 0).to_numpy(zero_copy_only=False)
            at = h & (n_bits - 1)
            there = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & ~b.column(place).is_null().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(there if inside else ~there))

    return arrow_stage(df, run, df.schema)
