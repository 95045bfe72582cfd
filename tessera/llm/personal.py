"""Personal data by regular expressions, checksums and context. DataFrame functions only.

A pattern proposes spans; a validator (octets, digit counts, Luhn, mod 97) confirms or drops each; words in the
CONTEXT_CHARS characters before a span move its score. The base kinds email, ip, card and phone stay whatever their
score; the added kinds iban, ssn and secret need LEAST_SCORE.

Positions come from the text between matches: split and regexp_extract_all cut at the same places. Groups repeat
possessively, so that long matches need no deep stack, and patterns begin only where a run begins.
Cases: null text is empty; positions are code points, ends exclusive; repeated rows give repeated results; a very long text is
processed whole, as one value; columns other than doc_id and text are not looked at, whatever they are called; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 40
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    against: str = ""


_LOCAL = "A-Za-z0-9._%+-"
KINDS = [
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"mail|contact|write|reach"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6, r"\bip\b|address|host|server|client|login", r"version|release|\bv\b|section"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", 0.8, r"card|credit|debit|visa|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, r"phone|call|tel\b|mobile|fax|contact"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.9, r"iban|account|bank|transfer"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.4, r"ssn|social|security"),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:token|secret|password|passwd|api_key|apikey)[ ]{0,3}[=:][ ]{0,3}\"[^\"\n]{12,}+\"", 0.8, r"key|secret|login|auth"),
]
BASE = ("email", "ip", "card", "phone")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def octets(x: Column) -> Column:
    """Four numbers of at most 255, leading zeros allowed."""
    return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})$"))


def luhn(x: Column) -> Column:
    """The check digit of card numbers: every second digit from the right counts twice, by its cross sum."""
    d = F.reverse(digits(x))
    at = F.sequence(F.lit(1), F.length(d))

    def weighed(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(at, F.lit(0), lambda s, i: s + weighed(i)) % 10 == 0


def mod97(x: Column) -> Column:
    """The check number of an IBAN: its first four characters go to the end, letters become 10 to 35, the rest by 97 is 1."""
    c = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.length(c).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1)


VALID = {"ip": octets, "card": luhn, "phone": lambda x: F.length(digits(x)).between(8, 15), "iban": mod97}


def placed(text: Column, found: Column, pattern: str) -> Column:
    """An array of (start, end, match) for the matches found: each stands after the pieces and matches before it."""
    between = F.split(text, pattern, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")
    both = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("match")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    all_of = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, all_of).otherwise(none)


def score(text: Column, kind: Kind, start: Column) -> Column:
    before = F.lower(F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS))))
    s = F.lit(kind.score) + F.when(before.rlike(kind.context), 0.3).otherwise(0.0)
    if kind.against:
        s = s - F.when(before.rlike(kind.against), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), s), 2)


def confirmed(kind: Kind) -> Column:
    """The spans proposed in the kind's column that its validator and score leave."""
    spans = F.col(kind.name)
    if kind.name in VALID:
        spans = F.filter(spans, lambda x: VALID[kind.name](x["match"]))
    spans = F.transform(spans, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(F.col("text"), kind, x["start"]).alias("score")))
    return spans if kind.name in BASE else F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, found: an array of (kind, start, end, score), by kind as listed, then start."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    needs = {"email": "@", "phone": "+", "secret": '"'}
    proposals = []
    for k in KINDS:
        found = F.regexp_extract_all("text", F.lit(k.pattern), 0)
        if k.name in needs:  # a text without this character is not searched
            found = F.when(F.contains("text", F.lit(needs[k.name])), found).otherwise(F.expr("cast(array() as array<string>)"))
        proposals.append(found.alias(k.name))
    rows = rows.select("doc_id", "text", *proposals)
    # positions first, as later steps use them more than once
    rows = rows.select("doc_id", "text", *[placed(F.col("text"), F.col(k.name), k.pattern).alias(k.name) for k in KINDS])
    return rows.select("doc_id", F.concat(*[confirmed(k) for k in KINDS]).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
