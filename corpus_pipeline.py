"""From raw documents to tokens. Each stage works on all that its predecessor kept; the last one returns token digests.

Cases: a text that is null, has no letter, or has no one language for half of its letters goes at the first stage, and a
missing lang is filled there; of rows that repeat a document one stays; a document whose lines all go stays with an empty
text until the near duplicates, of which one stays; rows of one doc_id are contaminated together; empty tables give empty
results; further columns are carried along, whatever they are called; very long texts are processed whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, lines, positional, simhash
from tessera.llm._common import documents, dropped, n_written, written, written_since

#: Words in a shingle of the near-duplicate stage, and the share of shingles that near duplicates have in common.
SHINGLE, RESEMBLANCE = 5, 0.8


def staged(stage: Callable) -> Callable:
    """A stage that first deletes the tables the stage before wrote on its way, as its result has been written by then (if not, they stay)."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        dropped(spark, getattr(sc, "_stage_tables", []), (docs,))
        begun = n_written(spark)
        out = stage(spark, docs, sf_dir)
        sc._stage_tables = written_since(spark, begun)
        return out

    return run


@staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that are `und` or have no language for half of their letters go. A null lang gets the language found."""
    return language.known(docs, language.learn(docs.where(~language.held_out(F.col("doc_id")))))


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of at least 40 code points that 5 documents or more have; the largest doc_id keeps them."""
    return lines.deduplicated(docs)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return simhash.without_near_duplicates(docs, SHINGLE, RESEMBLANCE)


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    found = positional.windows(positional.build(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit")).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.struct("*").alias("row"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("hit")), "left_anti").select("row.*")


@staged
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the bytes they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Neither learning a language model nor SimHash groups can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
