"""One text above every limit of what is processed at once, among short ones, against brute force."""

from __future__ import annotations

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from tessera.llm import _common, lm, positional, simhash, suffixes
from tessera.llm import queries as Q
from tests.llm import brute

LIMIT = max(_common.SLICE_BYTES, positional.BLOCK_BYTES, suffixes.SLICE, lm.BLOCK_BYTES)


@pytest.fixture(scope="module")
def long_docs():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijéß") for _ in range(rng.randint(2, 8))) for _ in range(5000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage = "A line that very many documents share with each other, again and again.", prose(120)
    body = "\n".join([x for _ in range(400) for x in (prose(2000), line)])
    whole = f"{body} {passage} mail me@example.org {passage} under the mit license {prose(50)}"
    assert len(whole.encode()) > LIMIT
    return [(1, whole, "en"), (2, passage + " " + prose(40), "en"), (3, f"{prose(10)}\n{line}", "en"), (4, line, "fr"), (5, f"{line}\nx", "fr"), (6, f"y {line.upper()}\n{line}", "fr"), (7, None, None)]


@pytest.fixture(scope="module")
def long_dir(spark, long_docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(i, t, lang, "s") for i, t, lang in long_docs], "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{d}/documents.parquet")
    w = brute.words(long_docs[0][1])
    items = [(1, " ".join(w[-60:-40])), (2, "none of these words stand anywhere in such an order at all"), (3, " ".join(w[3000:3009]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_suffix_dedup(spark, long_dir, long_docs):
    data = [(t or "").encode() for _, t, _ in long_docs]
    for length, column in ((400, "n_removed"), (256, "n_passage")):
        seen = Counter(hash(b[i : i + length]) for b in data for i in range(len(b) - length + 1))
        expected = {}
        for (i, _, _), b in zip(long_docs, data, strict=True):
            until = gone = 0
            for k in range(len(b) - length + 1):
                if seen[hash(b[k : k + length])] > 1:
                    gone += k + length - max(until, k)
                    until = k + length
            expected[i] = gone
        got = {r.doc_id: r[column] for r in Q.op6_suffix_dedup(spark, long_dir).collect()}
        assert got == expected and expected[1] and expected[2]


def test_words_and_lines(spark, long_dir, long_docs):
    pairs = [(i, t) for i, t, _ in long_docs]
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in Q.op7_line_dedup(spark, long_dir).collect()} == {i: x for (i, _), x in zip(pairs, brute.lines(pairs), strict=True)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{long_dir}/benchmark.parquet").collect()]
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in Q.op8_decontamination(spark, long_dir).collect()} == {i: brute.contamination(t, items) for i, t in pairs}
    licenses = {r.doc_id: r for r in Q.op5_licenses(spark, long_dir).collect()}
    words = brute.words(long_docs[0][1])
    assert {i: r.n_words for i, r in licenses.items()} == {i: len(brute.words(t)) for i, t in pairs}
    assert (licenses[1].n_base, licenses[1].first_word, licenses[1].labels) == (1, len(words) - 54, "mit") and words[-54:-50] == ["under", "the", "mit", "license"]


def test_fingerprints_and_scores(spark, long_dir, long_docs):
    fps = {i: brute.simhash(t) for i, t, _ in long_docs}
    assert {r.doc_id: r.fingerprint for r in Q.op10_simhash(spark, long_dir).collect()} == {i: format(x, "016x") for i, x in fps.items()}
    frame = spark.read.parquet(f"{long_dir}/documents.parquet")
    plain = lambda df: {r.doc_id: (r.n_words, r.n_backed_off, None if r.lm_score is None else round(r.lm_score, 9)) for r in df.collect()}
    assert plain(lm.score(frame)) == plain(lm.score_rows(frame))
    ordered = sorted(long_docs, key=lambda d: -d[0])
    following = {a[0]: b[1] or "" for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    edited = {i: brute.sha((t or "")[: len(t or "") - len(t or "") // 2] + following[i][: len(t or "") // 2]) for i, t, _ in long_docs}
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in Q.op2_fingerprints(spark, long_dir).collect()} == {i: (len(t or ""), edited[i]) for i, t, _ in long_docs}
    assert len(simhash.alike(frame, 5, 0.8).collect()) == len(long_docs)


def test_tokens_spans_and_languages(spark, long_dir, long_docs):
    bpe = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    ids = {i: bpe.encode_ordinary(t or "") for i, t, _ in long_docs}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256) for r in Q.op9_bpe(spark, long_dir).collect()} == {i: (len(x), brute.sha(",".join(map(str, x)))) for i, x in ids.items()}
    base = {i: {f"n_{k}": len(v) for k, v in brute.personal(t).items()} for i, t, _ in long_docs}
    assert {r.doc_id: {k: r[k] for k in base[1]} for r in Q.op3_personal_data(spark, long_dir).collect()} == base and base[1]["n_email"] == 1
    assert {r.doc_id: r.lang_pred for r in Q.op1_language(spark, long_dir).collect()}[7] == "und"
