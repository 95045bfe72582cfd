"""License scans: phrases, and an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a run of consecutive words, over line breaks too, of SPAN times as many words as the template has. It meets the
template if it has at least THRESHOLD of the template's distinct words. Template words are ordered by their frequency in
the whole corpus, rarest first. A block that meets a template of n words has o = ceil(THRESHOLD * n) of them, so one of
the first n - o + 1: only the words around such a prefix word are looked at, as many as blocks around it can have; then
the number of words (length filter), the words left after the common one (positional filter), the intersection with all
those words and at last that of each block decide. Blocks begin at a word of the template, as others have no more of it.
No block that meets a template is missed. Where two templates are met, by blocks that begin closer than a block is long,
the one that is met better counts; templates that are met equally well all count.

Words: A-Z lower-cased, then runs of digits, letters and non-ASCII characters. Cases: null text is empty; a phrase
that occurs several times counts each time; repeated rows give repeated results; texts are read whole, however long, and
only the words around prefix words are copied; columns other than doc_id and text are not looked at, whatever they are
called; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9

#: Fixed values.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Words of a block for each word of the template.
SPAN = 1.25
#: Well-known license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]

#: Words in a cell within which blocks are compared; it and its neighbours hold every block that begins near enough.
CELL = 1024

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text with one space between them."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, _BREAK, " "))


def spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def frequencies(docs: DataFrame) -> dict[str, int]:
    """How often the words of the templates occur in all texts. As many rows as those words."""
    wanted = sorted({w for _, t in TEMPLATES for w in t.split()})
    found = F.filter(F.split(spaced(F.col("text")), " "), lambda w: w.isin(wanted))
    return {r.w: r.n for r in docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def span_of(template: str) -> int:
    return math.ceil(SPAN * len(template.split()))


def prefix_index(docs: DataFrame, threshold: float) -> list[tuple]:
    """(word, template, label, words by rarity, least overlap, place of the word, words of a block) for each prefix word of each template."""
    counts, out = frequencies(docs), []
    for i, (label, text) in enumerate(TEMPLATES):
        ordered = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        least = math.ceil(round(threshold * len(ordered), 9))
        out += [(w, i, label, ordered, least, p, span_of(text)) for p, w in enumerate(ordered[: len(ordered) - least + 1])]
    return out


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, label, containment, start: the blocks that meet a template (by their first word, from 0), where none meets another better."""
    index = prefix_index(docs, threshold)
    widest = max(r[6] for r in index)
    reach = {w: max(r[6] for r in index if r[0] == w) for w in sorted({r[0] for r in index})}
    templates = docs.sparkSession.createDataFrame(index, "word string, template int, label string, words array<string>, least int, place int, span int")  # fixed: the templates
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    any_of, low = F.lit(False), F.lower("text")
    for w in reach:
        any_of = any_of | F.contains(low, F.lit(w))
    words = rows.where(any_of).select("doc_id", "text_hash", F.split(spaced(F.col("text")), " ").alias("w"))
    # only the words around a prefix word go on, as far as a block can reach
    far = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])
    places = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*reach))
    around = F.transform(places, lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), F.slice("w", F.greatest(x["at"] - far[x["word"]] + 2, F.lit(1)), 2 * far[x["word"]] - 1).alias("near"), F.greatest(x["at"] - far[x["word"]] + 1, F.lit(0)).alias("begin")))
    keyed = words.select("doc_id", "text_hash", F.inline(around))
    pairs = keyed.join(F.broadcast(templates), "word").where(F.size("near") >= F.col("least"))
    # words of the template before the common one that the block lacks can't be made up for later
    after = F.slice("words", F.col("place") + 1, F.size("words"))
    pairs = pairs.where(F.size(after) + F.size(F.array_intersect(F.slice("words", F.lit(1), F.col("place")), "near")) >= F.col("least"))
    pairs = pairs.where(F.size(F.array_intersect("words", "near")) >= F.col("least"))
    begins = F.filter(F.sequence(F.lit(1), F.size("near")), lambda j: F.array_contains("words", F.get("near", j - 1)) & (F.abs(F.col("begin") + j - 1 - F.col("at")) < F.col("span")) & (F.col("begin") + j - 1 <= F.col("at")))
    blocks = F.transform(begins, lambda j: F.struct((F.col("begin") + j - 1).alias("start"), F.size(F.array_intersect("words", F.slice("near", j, F.col("span")))).alias("overlap")))
    met = pairs.select("doc_id", "text_hash", "label", "least", "span", F.size("words").alias("n"), F.inline(blocks)).where("overlap >= least")
    met = met.select("doc_id", "text_hash", "label", "span", "start", (F.col("overlap") / F.col("n")).alias("containment")).distinct()
    assert widest <= CELL
    cells = met.select("*", F.explode(F.array(*[F.floor(F.col("start") / CELL) + k for k in (-1, 0, 1)])).alias("cell")).groupBy("doc_id", "text_hash", "cell").agg(F.collect_list(F.struct("label", "span", "start", "containment")).alias("all"))
    mine = F.filter("all", lambda x: F.floor(x["start"] / CELL) == F.col("cell"))
    best = F.filter(mine, lambda x: ~F.exists("all", lambda y: (y["containment"] > x["containment"]) & (F.abs(y["start"] - x["start"]) < x["span"])))
    return cells.select("doc_id", "text_hash", F.inline(best)).select("doc_id", "text_hash", "label", "containment", "start")


def phrases(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_base, first_word, last_word, base_labels (array): where the phrases' words stand consecutively."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), spaced(F.col("text")).alias("t"))
    rows = rows.select("doc_id", "text_hash", "t", F.concat(F.lit(" "), "t", F.lit(" ")).alias("s"))
    for i, (phrase, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"p{i}", F.when(F.contains("s", F.lit(f" {phrase} ")), F.split("s", f"(?<= ){phrase}(?= )", -1)))
    n, first, last = F.lit(0).cast("bigint"), [], []
    for i, (phrase, _) in enumerate(PHRASES):
        p = F.col(f"p{i}")
        n = n + F.coalesce(F.size(p) - 1, F.lit(0))
        first.append(spaces(p[0]) - 1)
        last.append(spaces(F.col("s")) - spaces(F.element_at(p, -1)) - phrase.count(" ") - 1)
    labels = F.array_compact(F.array(*[F.when(F.col(f"p{i}").isNotNull(), F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    n_words = F.when(F.col("t") == "", 0).otherwise(spaces(F.col("t")) + 1).cast("bigint")
    return rows.select("doc_id", "text_hash", n_words.alias("n_words"), n.alias("n_base"), F.least(*first).cast("bigint").alias("first_word"), F.greatest(*last).cast("bigint").alias("last_word"), F.array_sort(labels).alias("base_labels"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """phrases(), with labels (base ones and those of templates met) and score: the highest containment, 1 for a phrase."""
    met = matches(docs, threshold).groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
    found = phrases(docs)
    both = found.join(met, found["doc_id"].eqNullSafe(met["_doc"]) & (found["text_hash"] == met["_hash"]), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("met", F.expr("cast(array() as array<string>)"))))
    value = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), value.alias("score"))
