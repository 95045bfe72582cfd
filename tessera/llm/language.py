"""Language identification of whole texts and of the spans of mixed-language texts.

A word is a run of letters. Its script leaves as candidates the languages that were seen in that script; its score
in each is the log probability of its letters with their neighbours (hashed to BUCKETS). Viterbi over the words of
a document, where a change of language costs PENALTY, labels spans; the language with most letters is the text's.

The model comes from labelled rows, at most SAMPLE_DOCS document ids by the order of their hash. It has BUCKETS
numbers per language and is broadcast.
Cases: null texts and texts without letters are `und` with score 0 and have no spans, as are all texts if nothing was
learned; letters of an unseen script leave all languages as candidates; ties go to the language first by name;
rows without lang or doc_id are not learned from; repeated rows give repeated results; very long texts are read whole (a
text over SLICE_BYTES comes alone); other columns are not looked at, whatever they are called, and `known` carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import arrow_stage, slices, table

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
#: Bytes of text that go through Viterbi together.
TOGETHER_BYTES = 4 << 20
#: In nats.
PENALTY = 8.0
#: A text is in a language that has at least this share of its letters; `known` lets others go.
LEAST_SHARE = 0.5
#: A language is a candidate for a script that has at least this share of its letters.
SCRIPT_SHARE = 0.002

#: First code points of Unicode script ranges. 0 stands for all others.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]

_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """By code point: script + 1 of a letter, else 0; and the lower-case code point."""
    if not _TABLES:
        script, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                script[c] = 1
                if len(y := x.lower()) == 1:
                    low[c] = ord(y)
        for name, a, b in SCRIPTS:
            script[a : b + 1][script[a : b + 1] > 0] = 1 + SCRIPT_NAMES.index(name)
        _TABLES.extend([script, low])
    return _TABLES


@dataclass
class Words:
    """The words of a run of texts: number before each text, bounds, letters' buckets, and script of each word."""

    before: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buckets: np.ndarray
    first: np.ndarray
    scripts: np.ndarray


def read_words(texts: list[str | None]) -> Words:
    script, low = _tables()
    texts = [x or "" for x in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=offsets[1:])
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    kind = script[codes]
    letter = kind > 0
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    codes = np.where(letter, low[codes], 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    own = codes[at]
    left = np.where(at > 0, codes[at - 1], 0)
    right = codes[np.minimum(at + 1, len(codes) - 1)]
    mixed = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (own * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (right * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    buckets = (mixed >> np.uint64(48)).astype(np.int64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    before = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(before))
    return Words(before, starts - base, ends - base, buckets, first, kind[starts] - 1)


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # BUCKETS x languages, log probabilities
    seen: np.ndarray  # scripts x languages


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame) -> Model:
    """From columns doc_id, text and lang."""
    rows = labelled.where("lang is not null and text is not null and doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    top = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).head()[0]
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch):
                langs = b.column(1).to_pylist()
                w = read_words(b.column(0).to_pylist())
                lengths = w.ends - w.starts
                for lang in set(langs):
                    mine = np.repeat(np.array([x == lang for x in langs]), np.diff(w.before))
                    c = counts.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    c[:BUCKETS] += np.bincount(w.buckets[np.repeat(mine, lengths)], minlength=BUCKETS)
                    c[BUCKETS:] += np.bincount(w.scripts[mine], weights=lengths[mine], minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield table({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": c[at]}, schema)

    sample = rows.where(F.col("h") <= F.lit(top)) if top is not None else rows.limit(0)
    found = arrow_stage(sample.select("text", "lang"), count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = found.column("lang").to_pylist()
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    n = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(names)))
    n[found.column("bucket").to_numpy(), [number[x] for x in langs]] = found.column("n").to_numpy()
    letters, scripts = n[:BUCKETS], n[BUCKETS:]
    score = np.log((letters + 0.1) / (letters.sum(axis=0) + 0.1 * BUCKETS))
    seen = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    seen[~seen.any(axis=1)] = True
    return Model(names, score.astype(np.float32), seen)


def word_scores(model: Model, w: Words) -> np.ndarray:
    """words x languages; languages that a word's script rules out are far below the others."""
    if not len(w.starts):
        return np.zeros((0, len(model.languages)), np.float32)
    return np.add.reduceat(model.score[w.buckets], w.first, axis=0) - np.where(model.seen[w.scripts], 0, 1e4).astype(np.float32)


def viterbi(score: np.ndarray, before: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on its text's best path. All texts go forward together, word by word."""
    n_words, n_lang = np.diff(before), score.shape[1]
    order = np.argsort(-n_words, kind="stable")
    begins, lengths = before[:-1][order], n_words[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    kind = np.min_scalar_type(max(0, n_lang - 1))  # as many languages as there may be
    came = np.zeros(score.shape, kind)
    label = np.zeros(len(score), kind)
    best = np.zeros((len(order), n_lang), np.float32)
    own = np.arange(n_lang, dtype=kind)
    for t in range(longest):
        k = active[t]
        at = begins[:k] + t
        if t:
            now = best[:k]
            top = now.argmax(axis=1)
            change = now[np.arange(k), top][:, None] - np.float32(penalty)
            stay = now >= change
            came[at] = np.where(stay, own, top[:, None])
            best[:k] = np.where(stay, now, change) + score[at]
        else:
            best[:k] = score[at]
    state = best.argmax(axis=1).astype(kind)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begins[:k] + t
        label[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return label


def predictions(model: Model, column: pa.Array, penalty: float) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """For each text its language, that one's share of the letters, and the spans of its languages."""
    kept = []  # only counts, bounds and scores of the words, as all texts go through Viterbi together
    for b in slices(pa.RecordBatch.from_arrays([column], ["text"])) if model.languages else ():
        w = read_words(b.column(0).to_pylist())
        kept.append((np.diff(w.before), w.starts.astype(np.int32), w.ends.astype(np.int32), word_scores(model, w)))
    n = np.concatenate([x[0] for x in kept] or [np.zeros(len(column), np.int64)])
    starts, ends = (np.concatenate([x[i] for x in kept] or [np.zeros(0, np.int32)]) for i in (1, 2))
    before = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=before[1:])
    label = viterbi(np.concatenate([x[3] for x in kept]), before, penalty) if len(starts) else np.zeros(0, np.uint8)
    doc, k = np.repeat(np.arange(len(n)), n), max(1, len(model.languages))
    letters = np.bincount(doc * k + label.astype(np.int64), weights=ends - starts, minlength=len(n) * k).reshape(-1, k)
    total, top = letters.sum(axis=1), letters.argmax(axis=1)
    begin = np.ones(len(label), bool)
    begin[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(begin)
    until = np.append(at[1:], len(label)) - 1 if len(at) else at
    spans: list[list[tuple[int, int, str]]] = [[] for _ in n]
    for a, z in zip(at.tolist(), until.tolist(), strict=True):
        spans[doc[a]].append((int(starts[a]), int(ends[z]), model.languages[label[a]]))
    return [model.languages[x] if t else "und" for x, t in zip(top, total, strict=True)], letters[np.arange(len(n)), top] / np.maximum(total, 1), spans


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """docs' doc_id with lang_pred, score (its share of the letters), n_spans, and on request spans of code points with their language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())]
    out = "doc_id bigint, lang_pred string, score double, n_spans bigint"
    if spans:
        fields.append(("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        out += ", spans array<struct<start:int,end:int,lang:string>>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TOGETHER_BYTES):
                lang, score, found = predictions(shared.value, b.column(1), penalty)
                rows = {"doc_id": b.column(0), "lang_pred": lang, "score": score, "n_spans": [len(x) for x in found]}
                yield table(rows | ({"spans": [[{"start": a, "end": z, "lang": x} for a, z, x in each] for each in found]} if spans else {}), schema)

    return arrow_stage(docs.select(F.col("doc_id").cast("bigint"), "text"), run, out)


def known(docs: DataFrame, model: Model, penalty: float = PENALTY, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs, all columns, whose text is in a language: not `und`, and that language has at least so much of its letters.

    Where there is a column lang and it is null, it gets the language found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if dict(docs.dtypes).get("lang") == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", TOGETHER_BYTES):
                found, share, _ = predictions(shared.value, b.column(at), penalty)
                if lang is not None:
                    b = b.set_column(lang, b.schema.field(lang), pa.compute.coalesce(b.column(lang), pa.array(found, b.column(lang).type)))
                yield b.filter(pa.array([x != "und" and y >= least_share for x, y in zip(found, share.tolist(), strict=True)], pa.bool_()))

    return arrow_stage(docs, run, docs.schema)
