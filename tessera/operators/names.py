"""Names in texts and names like each other, as joins on keys that few rows share instead of pairs of all with all."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.answers import similarity_match
from tessera.operators.graph import cut, grams, spread

#: What separates words.
BETWEEN_WORDS = r"[^\p{L}\p{N}#]+"


def words_of(text: Column) -> Column:
    """The lower-cased words of a text, in order."""
    return F.filter(F.split(F.lower(text), BETWEEN_WORDS), lambda w: w != "")


def _key(words: Column) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def _runs(n: int) -> Column:
    """The keys of all runs of n words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.when(i + n - 1 <= F.size("words"), _key(F.slice("words", i, F.lit(n)))))


def standing(questions: DataFrame, names: DataFrame) -> DataFrame:
    """id, name, type: the names whose words stand one after another in a question, as the name writes them (case apart). questions: id, question; names: name, type.

    A question gives a key for each run of its words that is as long as some name, and a run meets only names of the same words:
    the joined rows are the matches, whatever words names begin with. Cases: a null or wordless name stands nowhere; a
    name that is there more than once in a question is reported once; names of equal words are all reported.
    """
    named = cut(names.select("name", "type", words_of(F.col("name")).alias("words")).where(F.size("words") > 0).distinct())
    lengths = sorted(r.n for r in named.select(F.size("words").alias("n")).distinct().collect())  # a row for each number of words
    keyed = cut(named.select(_key(F.col("words")).alias("key"), "name", "type"))
    asked = questions.select("id", "question", words_of(F.col("question")).alias("words"))
    runs = [_runs(n) for n in lengths]
    if not runs:
        return asked.select("id", F.lit("").alias("name"), F.lit("").alias("type")).limit(0)
    said = cut(asked.select("id", "question", F.explode(F.array_distinct(F.flatten(F.array(*runs)))).alias("key")).where("key is not null"))
    return spread(said, said.count(), "key").join(keyed, "key").where(F.contains(F.lower("question"), F.lower("name"))).select("id", "name", "type").distinct()


#: Characters of the runs that texts and what stands in them meet at: of those a part is long enough for, the longest.
RUNS = (1, 2, 3, 8, 16)


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """text, part: the distinct parts that stand in the distinct texts, in any case, inside words too. texts: text; parts: part.

    A text that holds a part holds all its runs of RUNS characters, so they meet at the part's run that the fewest texts have; then the whole
    decides. Runs of three alone would be shared by a fixed share of all numbered names. Only runs of some part are looked for
    in texts, and only of the lengths that some part has. An empty part is in none.
    """
    wanted = parts.select("part").where("part <> ''").distinct()
    size = F.greatest(*[F.when(F.length(F.lower("part")) >= k, k).otherwise(1) for k in RUNS])
    own = F.array().cast("array<string>")
    for k in RUNS:
        own = F.when(size == k, grams(F.col("part"), k)).otherwise(own)
    asked = cut(wanted.select("part", F.explode(own).alias("gram")))
    used = sorted(r.k for r in asked.select(F.length("gram").alias("k")).distinct().collect())  # as many as RUNS
    if not used:
        return texts.select("text", F.col("text").alias("part")).limit(0)
    have = F.array_distinct(F.flatten(F.array(*[grams(F.col("text"), k) for k in used])))
    held = texts.select("text").where("text is not null").distinct().select("text", F.explode(have).alias("gram"))
    held = cut(held.join(asked.select("gram").distinct(), "gram", "left_semi"))
    often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m"))
    rarest = cut(rarest.where("m.n > 0").select("part", "m.gram"))
    return rarest.join(held, "gram").where(F.contains(F.lower("text"), F.lower("part"))).select("text", "part")


def _tokens(name: Column, q: int) -> Column:
    """The runs of q characters of a name, each with its number among equal ones, so that names with a run twice share it twice."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - q + 1, F.lit(1))), lambda i: F.substr(name, i, F.lit(q)))
    return F.transform(runs, lambda g, i: F.concat_ws("\u0001", g, F.size(F.filter(F.slice(runs, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def similar(left: DataFrame, right: DataFrame, threshold: float = 0.9) -> DataFrame:
    """left, right: the pairs of distinct names (name) of two tables that are equal, one inside the other, or whose matching ratio (twice the
    matching characters over all) is at least `threshold`; case and space around them apart.

    Names in each other come by their rarest run, see `contained`. Of the others, names of a and b characters with the ratio
    t differ by at most (1 - t)(a + b) added or left out characters, each of which spoils at most two runs of two. So
    they share at least max(a, b) - 1 - 2 (1 - t)(a + b) runs (below 0.85 single characters are taken: t (a + b) / 2 of them); with each name's runs ordered by how
    many names have them, two such names share a run among the first ones, as many as may be missing and one more. What meets there is
    filtered by lengths and by the number of runs in common, and only then compared. Nulls and empty names are like nothing but what is equal.
    """
    t, q = threshold, 2 if threshold >= 0.85 else 1
    plain = lambda df, side: df.select(F.lower(F.trim("name")).alias(side), F.col("name").alias(f"{side}_name")).where("name is not null").distinct()
    a, b = cut(plain(left, "a")), cut(plain(right, "b"))
    inside = [contained(x.select(F.col(s).alias("text")), y.select(F.col(p).alias("part"))).select(F.col("text").alias(s), F.col("part").alias(p)) for x, s, y, p in ((a, "a", b, "b"), (b, "b", a, "a"))]
    empty = a.where("a = ''").select("a").join(b.where("b = ''").select("b"), F.col("a") == F.col("b"))
    each = [x.select(F.lit(s).alias("side"), F.col(s).alias("name")).where("name <> ''").distinct().withColumn("tokens", _tokens(F.col("name"), q)) for x, s in ((a, "a"), (b, "b"))]
    every = cut(each[0].unionByName(each[1]))
    often = every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = every.select("side", "name", F.explode("tokens").alias("token")).join(often, "token").groupBy("side", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens"))
    n = F.length("name")
    # what a name shares with any other of a possible length: least characters with the shortest, least runs of two with one of its own length
    shared = F.ceil(F.round(t * (n + F.ceil(F.round(n * t / (2 - t), 9))) / 2, 9)) if q == 1 else F.ceil(F.round(n - 1 - 4 * (1 - t) * n, 9))
    first = F.greatest(F.least(F.size("tokens") - F.greatest(shared, F.lit(1)) + 1, F.size("tokens")), F.lit(1)).cast("int")
    prefix = cut(ordered.select("side", "name", n.alias("n"), "tokens", F.explode(F.slice("tokens", F.lit(1), first)).alias("token")))
    of = lambda s: prefix.where(F.col("side") == s).select("token", F.col("name").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}"))
    total = F.col("na") + F.col("nb")
    near = of("a").join(of("b"), "token").where(F.round(2 * F.least("na", "nb") / total, 9) >= t)
    common = F.size(F.array_intersect("ta", "tb"))
    need = F.ceil(F.round(t * total / 2, 9)) if q == 1 else F.greatest("na", "nb") - 1 - 2 * F.floor(F.round((1 - t) * total, 9))
    close = cut(near.where(common >= need).select("a", "b").distinct())

    @F.pandas_udf(T.BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similarity_match(p, r, t) for p, r in zip(x, y, strict=True)])

    pairs = reduce(DataFrame.unionByName, [x.select("a", "b") for x in (*inside, empty, close.where(alike("a", "b")))]).distinct()
    return pairs.join(a, "a").join(b, "b").select(F.col("a_name").alias("left"), F.col("b_name").alias("right"))
