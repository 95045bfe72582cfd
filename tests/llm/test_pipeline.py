"""The pipeline, stage by stage, against brute force."""

from __future__ import annotations

import random

import corpus_pipeline as P
from tessera.llm import language, simhash
from tessera.llm._common import written
from tests.llm import brute
from tests.llm.test_operators import docs, empty_dir, multiset, sf_dir  # noqa: F401


def test_stages(spark, sf_dir):  # noqa: F811
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = frame.columns, {}
    for name, stage in P.STAGES:
        before = [r.asDict() for r in frame.collect()]
        frame = written(stage(spark, frame, sf_dir), name)
        seen[name] = (before, [r.asDict() for r in frame.collect()])
        if name != P.STAGES[-1][0]:
            assert frame.columns == columns
    before, after = seen["language_id"]
    assert len(after) == sum(any(c.isalpha() for c in r["text"] or "") for r in before)
    assert all(r["lang"] for r in after) and multiset(r["text"] for r in after) == multiset(r["text"] for r in before if any(c.isalpha() for c in r["text"] or ""))
    before, after = seen["line_dedup"]
    expected = brute.lines([(r["doc_id"], r["text"]) for r in before])
    assert sorted(map(repr, ((r["doc_id"], brute.sha(r["text"])) for r in after))) == sorted(map(repr, ((r["doc_id"], x[2]) for r, x in zip(before, expected, strict=True))))
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["near_dedup"]
    before.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    groups = brute.alike([r["text"] for r in before], 5, 0.8)
    assert multiset((r["doc_id"], r["text"]) for r in after) == multiset((r["doc_id"], r["text"]) for i, r in enumerate(before) if groups[i] == i)
    assert len(after) < len(before)
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not brute.contamination(r["text"], items)[1]}
    before, after = seen["encoding"]
    assert {(r["doc_id"], r["decoded_sha256"]) for r in after} == {(r["doc_id"], brute.sha(r["text"])) for r in before}
    assert sorted(map(repr, (r.asDict() for r in P.run(spark, sf_dir).collect()))) == sorted(map(repr, after))


def test_near_duplicates_of_families(spark):
    """Thousands of texts: families of edited copies, a large one among them, and texts that only share a passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    prose, passage, texts = lambda n: [word() for _ in range(n)], [word() for _ in range(40)], []
    for family in range(120):
        base = prose(rng.randint(8, 160))
        for _ in range(400 if family == 0 else rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [" ".join(prose(60) + passage + prose(60)) for _ in range(400)] + ["", "one two", "one two", "one two three four five six"]
    rng.shuffle(texts)
    groups = brute.alike(texts, 5, 0.8)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    kept = sorted(r.doc_id for r in simhash.without_near_duplicates(df, 5, 0.8).collect())
    assert kept == [i for i, g in enumerate(groups) if g == i] and 120 < len(kept) < len(texts)


def test_language_shares(spark):
    """A text of which no language has half goes; labels that are missing are filled; 300 languages are told apart."""
    names = [f"l{i:03d}" for i in range(300)]
    own = lambda i: " ".join(chr(0x4E00 + 8 * i + j % 8) * 3 for j in range(12))  # noqa: E731  letters of its own
    rows = [(i, own(i), names[i]) for i in range(300)] + [(900, own(299), None), (901, " ".join(own(i) for i in (1, 120, 290)), None), (902, "123", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(df)
    kept = {r.doc_id: r.lang for r in language.known(df, model).collect()}
    assert kept == {i: names[i] for i in range(300)} | {900: "l299"}


def test_empty(spark, empty_dir):  # noqa: F811
    assert P.run(spark, empty_dir).count() == 0
