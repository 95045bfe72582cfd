"""Vector search by cosine: every query against every row, blockwise, or an inverted file of cells and the rows of those near a query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import cut

#: Query vectors that are broadcast at once, and rows that a worker compares them to at once.
QUERY_BLOCK, ROW_BLOCK = 4096, 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


class Best:
    """The k best rows of each query so far, by score rounded to 12 digits, ties by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)  # of the k-th best

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each of some queries, a column for each of some rows."""
        scores = np.round(scores, 12)
        bar = self.least[queries]
        if scores.shape[1] >= self.k:
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero(scores >= bar[:, None])
        if not len(i):
            return
        query, id_, score = np.concatenate([self.query, queries[i]]), np.concatenate([self.id, ids[j]]), np.concatenate([self.score, scores[i, j]])
        order = np.lexsort((id_, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        self.query, self.id, self.score = query[keep], id_[order][keep], score[order][keep]
        full = rank[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def _matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, float).reshape(len(vectors), -1) if vectors else np.zeros((0, 1))


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k rows most like each query by cosine, ties by id. rows and queries: id, vector.

    Queries go out in blocks of QUERY_BLOCK, one after another, against ROW_BLOCK rows at once. Each partition keeps its own best k of a query, so at most k rows for
    each query and partition are shuffled.
    """
    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        collected = part.select("id", "vector").collect()
        ids = np.array([r.id for r in collected], np.int64)
        shared = spark.sparkContext.broadcast((ids, _units(_matrix([r.vector for r in collected]))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, m = shared.value
            best, every = Best(len(q), k), np.arange(len(q))
            for batch in (x.slice(i, ROW_BLOCK) for x in batches for i in range(0, x.num_rows, ROW_BLOCK)):
                if not len(q):
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                best.add(every, batch.column(0).to_numpy(zero_copy_only=False), m @ _units(v).T)
            yield pa.RecordBatch.from_arrays([pa.array(q[best.query]), pa.array(best.id), pa.array(best.score)], schema=schema)

        own = rows.select(F.col("id").cast("bigint"), "vector").where("vector is not null").mapInArrow(run, "query_id bigint, id bigint, score double")
        if blocks > 1:  # one block at a time is held, by the driver and the workers
            own = cut(own)
            shared.unpersist()
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Vectors that an index is fitted on, at most, by the order of a seeded hash of their ids; and cells, at most.
SAMPLE, CELLS = 20_000, 4096


@dataclass(frozen=True)
class Index:
    """An inverted file: rows (cell, id, vector) in folders by cell, the cells' centres at length 1, and how many of them a query looks into."""

    rows: DataFrame
    centres: np.ndarray
    probes: int


def centres_of(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of vectors of length 1, by rounds of k-means on the sphere from rows spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        at = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        centres = np.where(np.bincount(at, minlength=cells)[:, None] > 0, _units(sums), centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The cells to look into so that, within the sample, at least `recall` of the k nearest of up to 200 vectors are in them.

    A sample is thinner than the whole, so its nearest lie farther off, in more cells: the whole's recall is rather higher.
    """
    asked = sample[np.linspace(0, len(sample) - 1, min(200, len(sample))).astype(int)]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    cell = (sample @ centres.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def build_index(rows: DataFrame, path: str, k: int = 10, recall: float = 0.98, cells: int | None = None, seed: int = 42) -> Index:
    """The index of all rows (id, vector), written to path. Null vectors are in no cell.

    Centres are fitted on SAMPLE rows at most; every row goes to the cell of its nearest centre (the first of equal ones). Cells
    are written by ranges of (cell, id), so a cell with a large part of all rows is many tasks and files.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "vector").where("vector is not null")
    n = rows.count()
    drawn = [r.vector for r in rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(SAMPLE).select("vector").collect()]  # bounded by SAMPLE
    sample = _units(_matrix(drawn))
    centres = centres_of(sample, min(len(sample), cells or max(1, min(CELLS, round(n**0.5))))) if len(sample) else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)  # CELLS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _units(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([pa.array((v @ shared.value.T).argmax(axis=1).astype(np.int32)), b.column(0), b.column(1)], ["cell", "id", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    placed = rows.mapInArrow(run, f"cell int, id bigint, vector {kind}")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").mode("overwrite").parquet(path)
    stored = spark.read.schema(f"id bigint, vector {kind}, cell int").parquet(path)
    return Index(stored, centres, probes_for(sample, centres, k, recall) if len(sample) else 0)


def search_index(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows most like each query of those in its nearest cells; with all cells it is the exact way, `top_k`."""
    spark = index.rows.sparkSession
    probes = min(index.probes if probes is None else probes, len(index.centres))
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        collected = part.where("vector is not null").select("id", "vector").collect()  # a block of queries
        ids = np.array([r.id for r in collected], np.int64)
        m = _units(_matrix([r.vector for r in collected]))
        cells = np.argsort(-(m @ index.centres.T), axis=1, kind="stable")[:, :probes] if len(ids) and probes else np.zeros((len(ids), 0), int)
        asked = {int(c): np.flatnonzero((cells == c).any(axis=1)) for c in np.unique(cells)}
        shared = spark.sparkContext.broadcast((ids, m, asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, m, asked = shared.value
            best = Best(len(ids), k)
            for batch in (x.slice(i, ROW_BLOCK) for x in batches for i in range(0, x.num_rows, ROW_BLOCK)):
                v = _units(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
                cell, id_ = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
                for c in np.unique(cell).tolist():
                    who, own = asked[c], np.flatnonzero(cell == c)
                    best.add(who, id_[own], m[who] @ v[own].T)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.id), pa.array(best.score)], schema=schema)

        wanted = index.rows.where(F.col("cell").isin(sorted(asked))) if asked else index.rows.limit(0)  # only these cells' folders are read
        own = wanted.select("cell", "id", "vector").mapInArrow(run, "query_id bigint, id bigint, score double")
        if blocks > 1:
            own = cut(own)
            shared.unpersist()
        found = own if found is None else found.unionByName(own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact rows (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).head()[0] or 0.0


def route(questions: DataFrame, utterances: DataFrame) -> DataFrame:
    """id, label, distance: the label of the nearest utterance (label, vector) by Euclidean distance, ties by label.

    Utterances go out in blocks of QUERY_BLOCK, so a question gives one row for each block.
    """
    spark = questions.sparkSession
    blocks = max(1, -(-utterances.count() // QUERY_BLOCK))
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("distance", pa.float64())])
    found = None
    for b in range(blocks):
        part = utterances if blocks == 1 else utterances.where(F.pmod(F.xxhash64("label", "vector"), F.lit(blocks)) == b)
        known = sorted((str(r.label), r.vector) for r in part.select("label", "vector").collect())
        shared = spark.sparkContext.broadcast(([x for x, _ in known], np.array([v for _, v in known], float)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            labels, u = shared.value
            for batch in batches:
                if not batch.num_rows or not len(labels):
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                gap = np.round(np.sqrt(np.stack([((v - x) ** 2).sum(axis=1) for x in u], axis=1)), 9)
                at = gap.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([labels[i] for i in at]), pa.array(gap[np.arange(len(at)), at])], schema=schema)

        own = questions.select(F.col("id").cast("bigint"), "vector").where("vector is not null").mapInArrow(run, "id bigint, label string, distance double")
        if blocks > 1:
            own = cut(own)
            shared.unpersist()
        found = own if found is None else found.unionByName(own)
    return found.groupBy("id").agg(F.min(F.struct("distance", "label")).alias("m")).select("id", "m.label", "m.distance")


def gate(node_scores: DataFrame, edge_scores: DataFrame, threshold: float = 0.9) -> DataFrame:
    """query_id, best, passes: whether the nearest of nodes and edges (query_id, distance) is near enough."""
    both = node_scores.unionByName(edge_scores).groupBy("query_id").agg(F.min("distance").alias("best"))
    return both.withColumn("passes", F.col("best") <= threshold)
