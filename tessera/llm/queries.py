"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, codes, language, ledger, licenses, lines, lm, personal, positional, prefixes, ranked, simhash, suffixes
from tessera.llm._common import arrow_stage, documents, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir)
    model = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return prefixes.compared(documents(spark, sf_dir))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text."""
    found = personal.find(documents(spark, sf_dir))
    of = lambda k: F.filter("found", lambda x: x["kind"] == k)
    base = F.filter("found", lambda x: x["kind"].isin(*personal.BASE))
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in personal.BASE]
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return found.select("doc_id", *counts, F.sha2(personal.joined(base), 256).alias("base_sha256"), personal.joined(F.col("found")).alias("spans"), best.alias("max_score"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score by the counts of all other documents."""
    return lm.score(documents(spark, sf_dir)).withColumn("lm_score", F.round("lm_score", 6))


def op4_trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with three words: trigrams, backing off to bigrams and words, with all counts."""
    return lm.score(documents(spark, sf_dir), 3).withColumn("lm_score", F.round("lm_score", 6))


def op4_relational_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of op4_lm_scores with a row for each n-gram on the way."""
    return lm.score_rows(documents(spark, sf_dir)).withColumn("lm_score", F.round("lm_score", 6))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and lines like license templates in every text."""
    found = licenses.scan(documents(spark, sf_dir))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 400-byte strings that occur again are removed from every text; n_passage tells the bytes in repeats of 256 or more."""
    docs = documents(spark, sf_dir)
    rows = suffixes.with_spans(docs, suffixes.repeats(docs, (suffixes.PASSAGE, suffixes.LENGTH)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passage", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() or b"" for x in b.column(1).cast(pa.large_binary())]
            spans = [x.as_py() or [] for x in b.column(2)]
            kept = [suffixes.without_spans(t, [x for x in each if x["length"] == suffixes.LENGTH]) for t, each in zip(texts, spans, strict=True)]
            passages = [int(suffixes.covered(len(t), [x for x in each if x["length"] == suffixes.PASSAGE]).sum()) for t, each in zip(texts, spans, strict=True)]
            yield table({"doc_id": b.column(0), "n_bytes": [len(t) for t in texts], "n_removed": [x[1] for x in kept], "n_spans": [x[2] for x in kept], "kept_sha256": [hashlib.sha256(x[0]).hexdigest() for x in kept], "n_passage": passages}, schema)

    return arrow_stage(rows, digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage bigint")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points found in at least 5 documents stay only in the largest doc_id."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = lines.with_bitmaps(docs, lines.bitmaps(lines.drops(docs))).select(F.col("row.doc_id").cast("bigint").alias("doc_id"), "text", "keep")
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [lines.kept_lines(t.as_py() or b"", k.as_py()) for t, k in zip(b.column(1).cast(pa.large_binary()), b.column(2), strict=True)]
            yield table({"doc_id": b.column(0), "n_lines": [x[1] for x in kept], "n_dropped": [x[2] for x in kept], "kept_sha256": [hashlib.sha256(x[0]).hexdigest() for x in kept]}, schema)

    return arrow_stage(rows, digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = positional.windows(positional.build(documents(spark, sf_dir)), items, 10)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the multilingual byte-level vocabulary."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints of 4-word shingles are linked at 4 bits or fewer."""
    return simhash.near_duplicates(documents(spark, sf_dir), 4)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 documents of highest score for each benchmark item."""
    return ranked.search(ranked.build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as four indexes of codebooks of 256 entries, fitted in four rounds."""
    return codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, each distinct text scanned once."""
    found = ledger.scan(documents(spark, sf_dir))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*ledger.BASE))
    return found.select(F.col("path").alias("doc_id"), *[of(k) for k in ledger.BASE], F.sha2(ledger.joined(base), 256).alias("base_sha256"), ledger.joined(F.col("spans")).alias("spans"))


QUERIES = {"op1_language": op1_language, "op2_fingerprints": op2_fingerprints, "op3_personal_data": op3_personal_data, "op4_lm_scores": op4_lm_scores, "op4_trigram_scores": op4_trigram_scores, "op4_relational_scores": op4_relational_scores, "op5_licenses": op5_licenses, "op6_suffix_dedup": op6_suffix_dedup, "op7_line_dedup": op7_line_dedup, "op8_decontamination": op8_decontamination, "op9_bpe": op9_bpe, "op10_simhash": op10_simhash, "op11_ranked_search": op11_ranked_search, "op12_vector_codes": op12_vector_codes, "op13_secrets": op13_secrets}
