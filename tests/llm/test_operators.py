"""The ten queries against brute force, on texts that are null, empty, long, repeated and near each other, with columns of clashing names."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, language, lines, lm, personal, positional, prefixes, simhash, sql, suffixes
from tessera.llm import queries as Q
from tests.conftest import DATA, rows_of
from tests.llm import brute

EXTRA = ["row_id", "text_hash", "fp", "_doc", "_hash", "start", "line", "h1", "gram", "block", "part", "bucket", "ahead", "found", "words", "items", "spans", "least", "root", "t", "s", "key", "score"]


def texts() -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, common = prose(110), "A line that very many documents share with each other."
    out: list = [(1, None, None), (2, "", "en"), (3, "x", "en"), (4, " \n\t\n ", "fr"), (5, "!!! 123", None), (None, "no id " + passage, "en"), (None, None, None)]
    for i in range(10, 40):
        body = prose(rng.randint(5, 150))
        if i % 3 == 0:
            body += "\n " + (common.upper() if i % 2 else common) + "\t\n" + prose(10) + "\n" + common
        if i % 5 == 0:
            body = body[: len(body) // 2] + " " + passage + " " + body[len(body) // 2 :]
        if i % 7 == 0:
            body += " write to a.b@c-d.example.org or +1 (212) 555-0100, card 4111 1111 1111 1111 from 10.0.0.1 and 300.1.1.1"
        if i % 8 == 0:
            body += "\nReleased under the MIT License. Apache License, Version 2.0; CC BY-NC cc by nc"
        out.append((i, body, rng.choice(["en", "fr"])))
    out += [(50, out[20][1], "en"), (51, out[20][1] + " z", "en"), (52, out[20][1], "en"), (52, out[20][1], "en"), (60, prose(9000), "fr"), (61, "ab " * 700, "en"), (62, "日本語 テキスト\U0001f600 " * 60, "ja"), (63, "y" * 5000, "en")]
    return out


@pytest.fixture(scope="module")
def docs():
    return texts()


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = spark.createDataFrame([(i, t, lang, "s", len(t) if t else None) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(5).write.parquet(f"{d}/documents.parquet")
    w = brute.words(docs[12][1])
    items = [(1, " ".join(w[3:20])), (2, None), (3, ""), (None, " ".join(w[5:15])), (5, "Zz qq"), (6, " ".join(w[0:3])), (6, "ab ab"), (7, "ab " * 12)]
    spark.createDataFrame(items, "item_id long, text string").withColumn("terms", F.lit(1)).write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, [0.5, 0.25, 0.0, -1.0], 1)], "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("clash")).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def multiset(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert Q.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_against_sql(spark, duck, name):
    frame = Q.QUERIES[name](spark, DATA)
    found = duck.execute(sql.SQL[name])
    columns = sorted(c[0] for c in found.description)
    expected = [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]
    assert sorted(frame.columns) == columns
    assert rows_of(columns, [r.asDict() for r in frame.collect()]) == rows_of(columns, expected)


def test_language(spark, sf_dir, docs):
    got = Q.op1_language(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "ja", "und")
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 4, 5} <= und and not und & {3, 10, 60, 62}


def test_language_accuracy(spark):
    rows = Q.op1_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).head()[0] > 0.97


def test_language_spans(spark):
    known = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden with the trees", "en"), ("la maison et le jardin avec les arbres", "fr"), ("дом и сад с деревьями", "ru")] * 3)], "doc_id long, text string, lang string")
    model = language.learn(known)
    both = spark.createDataFrame([(1, "the house and the garden with the trees. la maison et le jardin avec les arbres; сад")], "doc_id long, text string")
    spans = language.identify(both, model, penalty=3.0, spans=True).head().spans
    assert [(s.start, s.end, s.lang) for s in spans] == [(0, 39, "en"), (41, 79, "fr"), (81, 84, "ru")]
    assert language.learn(known.where("lang is null")).languages == []


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    from itertools import product

    before = np.array([0, 5, 5, 9])
    score = rng.normal(size=(9, 3)).astype(np.float32)
    got = language.viterbi(score, before, 0.7)
    for a, b in ((0, 5), (5, 9)):
        value = lambda p, a=a: sum(score[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        assert value(tuple(got[a:b])) == pytest.approx(max(map(value, product(range(3), repeat=b - a))), abs=1e-5)


def test_fingerprints(spark, sf_dir, docs):
    got = Q.op2_fingerprints(spark, sf_dir).collect()
    order = sorted(docs, key=lambda d: (-(d[0] if d[0] is not None else -(1 << 63)), d[1] is not None, d[1] or ""))
    expected = []
    for i, (k, t, _) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        expected.append((k, len(t), brute.sha(edited), prefixes.fingerprint(prefixes.PrefixHashes(t)), prefixes.fingerprint(prefixes.PrefixHashes(edited))))
    assert multiset((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == multiset(expected)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_prefix_hashes():
    p, q = prefixes.PrefixHashes("abcabcabd"), prefixes.PrefixHashes("xabcabd")
    assert p.common(0, p, 3) == 5 and p.common(3, q, 1) == 6 and p.common(0, q, 0) == 0 and p.common(9, q, 7) == 0
    assert len(set(p.windows(3).tolist())) == 4
    a, b = "the quick brown fox " * 50, "pack my box with jugs " * 50
    f = lambda t: prefixes.fingerprint(prefixes.PrefixHashes(t))
    assert prefixes.likeness(f(a), f(a)) == 1 and prefixes.likeness(f(a), f(b)) < 0.3 and prefixes.likeness(f(""), f(a)) == 0


def test_personal_data(spark, sf_dir, docs):
    got = multiset((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in Q.op3_personal_data(spark, sf_dir).collect())
    expected = []
    for i, t, _ in docs:
        p = brute.personal(t)
        expected.append((i, *map(len, p.values()), brute.sha(",".join(f"{k}:{a}:{b}" for k, v in p.items() for a, b in v))))
    assert got == multiset(expected)


def test_personal_data_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "@", ".", "1", "12", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "+1", "(555)", "x", "_", "é", "1.2.3.4", "..", "\n", " 1", "%", "4", "b.c", "日"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(1500)] + [(9000, "1 " * 20000), (9001, "a" * 20000 + "@" + "b." * 20000 + "c")]
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.found if x.kind in personal.BASE] for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:-2]:
        assert found[i] == [(k, a, b) for k, v in brute.personal(t).items() for a, b in v], t
    assert found[9000] == [] and found[9001] == [("email", 0, 60002)]
    extra = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE89 3704 0044 0532 0130 01"), (3, "ssn 123-45-6789"), (4, "no 123-45-6789"), (5, None)], "doc_id long, text string")
    kinds = {r.doc_id: [x.kind for x in r.found] for r in personal.find(extra).collect()}
    assert kinds == {1: ["iban"], 2: [], 3: ["ssn"], 4: [], 5: []}


def test_lm_scores(spark, sf_dir, docs):
    import math
    from collections import Counter

    w = [brute.words(t) for _, t, _ in docs]
    uni, bi = Counter(x for d in w for x in d), Counter(p for d in w for p in zip(d, d[1:], strict=False))
    total, expected = sum(uni.values()), []
    for (i, _, _), d in zip(docs, w, strict=True):
        u, b, logs, back = Counter(d), Counter(zip(d, d[1:], strict=False)), [], 0
        for k, x in enumerate(d):
            c = uni[x] - u[x]
            s = c / (total - len(d)) if c else 1 / (total - len(d) + 1)
            if k:
                p = (d[k - 1], x)
                s = (bi[p] - b[p]) / (uni[p[0]] - u[p[0]]) if bi[p] > b[p] else lm.BACKOFF * s
            back += not k or bi[d[k - 1], x] <= b[d[k - 1], x]
            logs.append(math.log10(s))
        expected.append((i is None, i, len(d), back, sum(logs) / len(d) if d else 9))
    got = [(r.doc_id is None, r.doc_id, r.n_words, r.n_backed_off, 9 if r.lm_score is None else r.lm_score) for r in Q.op4_lm_scores(spark, sf_dir).collect()]
    order = lambda x: repr(x[:4])
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=2e-6)
    three = lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3).collect()
    assert len(three) == len(docs) and sum(r.n_words for r in three) == total


def test_lists_pack():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        c = rng.integers(1, 9, len(h))
        a, b = lm.unpack(lm.pack(h, c))
        assert (a == h).all() and (b == c).all()


def test_licenses(spark, sf_dir):
    got = {r.doc_id: r for r in Q.op5_licenses(spark, sf_dir).collect()}
    r = got[16]
    assert r.n_base == 4 and r.base_labels == "apache-2,cc-by-nc,mit" and r.score == 1.0
    assert got[1].n_words == 0 and got[1].labels == "" and got[1].first_word is None
    line = spark.createDataFrame([(1, "x\nLicensed under the GNU General Public License version 3"), (2, "licensed under the general public license")], "doc_id long, text string")
    from tessera.llm import licenses

    assert {r.doc_id: (r.labels, r.score) for r in licenses.scan(line).collect()} == {1: (["gpl-3"], 1.0), 2: ([], 0.0)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_rows(spark, sf_dir, order):
    """The packed relations and the plain ones give the same."""
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = lambda df: multiset((r.doc_id, r.n_words, r.n_backed_off, None if r.lm_score is None else round(r.lm_score, 9)) for r in df.collect())
    assert plain(lm.score(frame, order)) == plain(lm.score_rows(frame, order))


def test_likeness_against_spans(spark, sf_dir, docs):
    """near_edited and near_next against the share of spans that the texts really have in common."""
    rows = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in Q.op2_fingerprints(spark, sf_dir).collect()}
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    spans = lambda t: {t[i : i + prefixes.WINDOW] for i in range(max(1, len(t) - prefixes.WINDOW + 1))} if t else set()
    dice = lambda a, b: 1.0 if a == b else 2 * len(spans(a) & spans(b)) / max(1, len(spans(a)) + len(spans(b)))
    errors = []
    for (i, t, _), (_, following, _) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = rows.get((i, len(t), brute.sha(edited)))
        if r is not None and len(t) > 300:  # rows of one id may follow each other otherwise
            errors += [abs(r.near_edited - dice(t, edited)), abs(r.near_next - dice(t, following))]
    assert len(errors) > 40 and sum(errors) / len(errors) < 0.03 and max(errors) < 0.16


def test_language_query_takes_text_alone(spark, sf_dir, tmp_path):
    """held_out is that of the ids, and neither lang nor source of held-out documents nor anything but text tells on a prediction."""
    import zlib

    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    before = Q.op1_language(spark, sf_dir).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in before) and any(r.held_out for r in before)
    other = frame.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    other.write.parquet(f"{tmp_path}/documents.parquet")
    after = Q.op1_language(spark, str(tmp_path)).collect()
    assert multiset(before) == multiset(after)


def test_wrapped_notices(spark):
    """Whole notices over many lines, with words lost, in long texts; words alone or far apart are none."""
    from tessera.llm import licenses

    rng = random.Random(2)
    wrap = lambda words: "\n# ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    notice = {label: text for label, text in licenses.TEMPLATES if len(text.split()) > 30}
    prose = lambda n: [rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) for _ in range(n)]
    rows, expected = [], {}
    for i, (label, text) in enumerate(sorted(notice.items())):
        words = text.split()
        distinct = sorted(set(words))
        lost = set(rng.sample([w for w in distinct if not w.isdigit() and w != "lesser"], len(distinct) // 12))  # what tells versions apart stays
        half = set(distinct[::2])
        rows += [(3 * i, wrap(prose(500) + words + prose(500)).upper()), (3 * i + 1, wrap([w for w in words if w not in lost])), (3 * i + 2, wrap([w for w in words if w in half] + prose(2000) + [w for w in words if w not in half]))]
        expected |= {3 * i: ([label], 1.0), 3 * i + 1: ([label], (len(distinct) - len(lost)) / len(distinct)), 3 * i + 2: ([], 0.0)}
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (labels, round(score, 9)) for k, (labels, score) in got.items()} == {k: (labels, round(score, 9)) for k, (labels, score) in expected.items()}


@pytest.mark.parametrize("crowd", [suffixes.SHARD_PIECES, 3, 1])
def test_suffixes(spark, sf_dir, docs, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_PIECES", crowd)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in Q.op6_suffix_dedup(spark, sf_dir).collect()]
    passages = [x[1] for x in brute.repeats([t for _, t, _ in docs], 256)]
    expected = [(d[0], *x, n) for d, x, n in zip(docs, brute.repeats([t for _, t, _ in docs], 400), passages, strict=True)]
    assert multiset(got) == multiset(expected) and any(r[2] for r in got)


@pytest.mark.parametrize("size", [90, 300, 600])
def test_crowded_passage(spark, size):
    """A passage that thousands of different texts share: below a window, between the two lengths, and above both."""
    rng = random.Random(size)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(size))
    body = lambda: "".join(rng.choice("klmnopqrst ") for _ in range(rng.randint(100, 300)))
    docs = [(i, body() + passage + body()) for i in range(3000)]
    rows = suffixes.repeats(spark.createDataFrame(docs, "doc_id long, text string"), (256, 400)).collect()
    assert len(rows) == (len(docs) if size > 256 else 0)
    at = {i: t.encode().index(passage.encode()) for i, t in docs}
    for r in rows:
        for length in (256, 400):
            own = [x for x in r.spans if x["length"] == length]
            lo, hi = (min(x["a"] for x in own), max(x["b"] for x in own)) if own else (0, 0)
            if size < length:
                assert not own
            else:  # a neighbour may have a byte or two more in common by chance
                assert at[r.doc_id] - 12 <= lo <= at[r.doc_id] and at[r.doc_id] + size <= hi <= at[r.doc_id] + size + 12


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 50))).astype(np.uint8)
        wanted, raw = rng.random(len(x)) < 0.5, x.tobytes()
        assert suffixes.suffix_array(x, 64).tolist() == sorted(range(len(x)), key=lambda i: raw[i:])
        assert [i for i in suffixes.suffix_array(x, 64, wanted).tolist() if wanted[i]] == sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:])


def test_lines(spark, sf_dir, docs):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in Q.op7_line_dedup(spark, sf_dir).collect()]
    expected = [(d[0], *x) for d, x in zip(docs, brute.lines([(i, t) for i, t, _ in docs]), strict=True)]
    assert multiset(got) == multiset(expected) and any(r[2] for r in got)


def test_lines_over_many_partitions(spark):
    """A key in more documents than a batch has rows, over several range partitions."""
    line = "one line of more than forty characters for all of them"
    rows = spark.range(25000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\nown line with a number of its own, which is "), F.col("id").cast("string")).alias("text")).repartition(7)
    gone = lines.drops(rows)
    assert gone.count() == 24999 and gone.agg(F.max("doc")).head()[0] == 24998


def test_decontamination(spark, sf_dir, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in Q.op8_decontamination(spark, sf_dir).collect()]
    expected = []
    for i, t, _ in docs:
        n, hit, names, digest = brute.contamination(t, items)
        expected.append((i, n, hit, names, digest, hit > 0))
    assert multiset(got) == multiset(expected) and any(r[5] for r in got)


def test_decontamination_in_parts(spark, sf_dir, monkeypatch):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    index = positional.build(read("documents"))
    whole = multiset(map(tuple, positional.windows(index, read("benchmark")).collect()))
    monkeypatch.setattr(positional, "BROADCAST_WORDS", 10)
    assert multiset(map(tuple, positional.windows(index, read("benchmark")).collect())) == whole


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red x x green y blue"), (2, "blue green red"), (3, "red green"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "Red green BLUE")], "item_id long, text string")
    index = positional.build(d)
    assert {(r.doc_id, r.start, r.end) for r in positional.proximity(index, q, 6).collect()} == {(1, 0, 6), (2, 0, 3)}
    assert {r.doc_id for r in positional.proximity(index, q, 3).collect()} == {2}


def test_bpe(spark, sf_dir, docs):
    import base64

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = [(i, len(x := t.encode_ordinary(s or "")), brute.sha(",".join(map(str, x))), brute.sha(s or "")) for i, s, _ in docs]
    assert multiset(map(tuple, Q.op9_bpe(spark, sf_dir).collect())) == multiset(expected)
    codec = bpe.codec_of(bpe.vocabulary_lines(path), public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", " ", " ", "\x1c", "\x85", "'s", "'re", "1", "٣", "!?", "\U0001f600", "́", "ing", "the", "\r\n"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert codec.encode(x) == t.encode_ordinary(x), repr(x)
        assert codec.decode(codec.encode(x)) == x.encode()
    frame = spark.createDataFrame([(1, "héllo wörld"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(frame, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == {1: "héllo wörld", 2: ""}


def test_bpe_edits():
    v = bpe.Vocabulary(bpe.vocabulary_lines(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    rng = random.Random(2)
    for _ in range(200):
        a, b, c = (bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(0, 12))) for _ in range(3))
        assert bpe.PrefixEncoder(v, a).append(b).ids() == bpe.PrefixEncoder(v, a + b).ids() == v.merged(a + b)
        at = rng.randint(0, len(a))
        until = rng.randint(at, len(a))
        assert bpe.PrefixEncoder(v, a).edit(at, until, c).ids() == v.merged(a[:at] + c + a[until:])


def test_simhash(spark, sf_dir, docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in Q.op10_simhash(spark, sf_dir).collect()]
    fps = [brute.simhash(t) for _, t, _ in docs]
    root = brute.groups(fps)
    least = {r: min((docs[i][0] for i in range(len(docs)) if root[i] == r and docs[i][0] is not None), default=None) for r in set(root)}
    assert multiset(got) == multiset((docs[i][0], format(fps[i], "016x"), least[root[i]]) for i in range(len(docs)))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 64])
def test_simhash_crowds(spark, bucket, monkeypatch):
    """Hundreds of fingerprints near each other, in buckets whole and dealt out as pairs of chunks."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for c in list(fps)[:4]:
        for _ in range(150):
            x = c
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.components(simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    label = {r.u: r.root for r in found}
    root = brute.groups(fps)
    mine = {}
    for i, x in enumerate(signed):
        mine.setdefault(label.get(x, x), set()).add(i)
    theirs = {}
    for i, r in enumerate(root):
        theirs.setdefault(r, set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_alike(spark):
    """Texts with a few words changed are found, texts that share less are left alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, family = [], {}
    for f in range(60):
        base = [word() for _ in range(300)]
        for k in range(4):
            w = base[:]
            for i in rng.sample(range(300), k):  # each changed word changes five shingles
                w[i] = word()
            rows.append((len(rows), " ".join(w)))
            family[len(rows) - 1] = f
        half = base[:150] + [word() for _ in range(150)]
        rows.append((len(rows), " ".join(half)))
        family[len(rows) - 1] = -f - 1
    rows += [(len(rows), None), (len(rows) + 1, "")]
    got = {r.doc_id: r.root for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8).collect()}
    assert got[300] == got[301]
    linked = sum(got[i] == got[i - family_start] for i, family_start in ((i, i % 5) for i in range(300) if family[i] >= 0 and i % 5))
    assert linked >= 0.95 * 180
    assert all(got[i] != got[i - 4] for i in range(300) if family[i] < 0)
    assert len({got[i] for i in range(0, 300, 5)}) == 60


def resembling(seed: int) -> list[str]:
    """Texts with 0 to 12 changed words of some base, most of them near a resemblance of 0.8, short and long; half have a common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, out = [word() for _ in range(12)], []
    for f in range(25):
        base = [word() for _ in range(rng.choice([3, 30, 60, 200, 400]))]
        base = base[:20] + passage + base[20:] if f % 2 else base
        for _ in range(12):
            w = base[:]
            for i in rng.sample(range(len(w)), min(len(w), rng.randint(0, 1 + len(w) // 25))):
                w[i] = word()
            out.append(" ".join(w))
    return [*out, *out[:5], "", " "]


def links_of(texts: list[str], size: int = 5, least: float = 0.8) -> list[tuple[int, int]]:
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return [(i, j) for j in range(len(sets)) for i in range(j) if not (sets[i] | sets[j]) or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 16])
def test_alike_finds_all(spark, bucket, monkeypatch):
    """No pair of a resemblance of 0.8 or more stays apart, however far apart the fingerprints are."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = resembling(11)
    got = {r.doc_id: r.root for r in simhash.alike(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8).collect()}
    pairs = links_of(texts)
    assert len(got) == len(texts) and [(i, j) for i, j in pairs if got[i] != got[j]] == []


def test_alike_links_no_others(spark):
    """Groups are those of the pairs of a resemblance of 0.8 or more, not a hundredth less."""
    texts = resembling(12)
    got = {r.doc_id: r.root for r in simhash.alike(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 0.8).collect()}
    root = list(range(len(texts)))
    for i, j in links_of(texts):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert len({(got[i], root[i]) for i in got}) == len(set(root)) == len(set(got.values()))


def test_trigram_scores(spark, sf_dir, docs):
    """The registered query of three words against brute force: the longest context seen elsewhere, BACKOFF for each given up."""
    import math
    from collections import Counter

    w = [brute.words(t) for _, t, _ in docs]
    grams = lambda d: Counter(tuple(d[i : i + k]) for k in (1, 2, 3) for i in range(len(d) - k + 1))
    every, total, expected = sum((grams(d) for d in w), Counter()), sum(map(len, w)), []
    for (i, _, _), d in zip(docs, w, strict=True):
        own, logs, back = grams(d), [], 0
        left = lambda g: every[g] - own[g]  # noqa: B023, E731
        for k, x in enumerate(d):
            s = left((x,)) / (total - len(d)) if left((x,)) else 1 / (total - len(d) + 1)
            for c in range(1, min(k, 2) + 1):
                g = tuple(d[k - c : k + 1])
                s = left(g) / left(g[:-1]) if left(g) else lm.BACKOFF * s
            back += not any(left(tuple(d[k - c : k + 1])) for c in range(1, min(k, 2) + 1))
            logs.append(math.log10(s))
        expected.append((i is None, i, len(d), back, sum(logs) / len(d) if d else 9))
    got = [(r.doc_id is None, r.doc_id, r.n_words, r.n_backed_off, 9 if r.lm_score is None else r.lm_score) for r in Q.QUERIES["op4_trigram_scores"](spark, sf_dir).collect()]
    order = lambda x: repr(x[:4])
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=2e-6)


def test_long_secrets(spark):
    """A quoted secret is found at any length."""
    rows = [(n, f'token = "{"aB3" * n}"') for n in (10, 66, 67, 500, 5000)]
    found = personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [x.kind for x in r.found] for r in found} == {n: ["secret"] for n, _ in rows}
