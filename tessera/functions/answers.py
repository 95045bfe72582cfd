"""What model replies say."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import constants as C
from tessera.functions.text import found, squeezed


def options(x: Column) -> Column:
    """The options "A. …" to "D) …" of a question."""
    pattern = r"(?sU)\b([A-D])[.)]\s*(.+?)(?=\s+[A-D][.)]\s+|$)"
    both = F.zip_with(F.regexp_extract_all(x, F.lit(pattern), 1), F.regexp_extract_all(x, F.lit(pattern), 2), lambda a, b: F.concat(a, F.lit(". "), squeezed(b)))
    return both


def verdict(x: Column) -> Column:
    t = F.upper(F.trim(x))
    return F.when(t == "ĐÚNG", "Đúng").when(t == "SAI", "Sai").when(F.contains(t, F.lit("KHÔNG ĐỦ THÔNG TIN")), "Không đủ thông tin").otherwise("Không xác định")


def choice(x: Column) -> Column:
    """The letter A to D that a reply settles on, by the first rule that applies; null if none does."""
    low, first_line = F.lower(x), F.trim(F.split_part(x, F.lit("\n"), F.lit(1)))
    last = F.lower(F.right(x, F.lit(200)))
    rules = [F.upper(found(x, r"^\s*([A-Da-d])", 1, "U")), F.upper(found(x, r"\[([A-D])\]", 1, "iU"))]
    rules[0] = F.when(F.substring(x, 2, 1).isin(".", ")", " ", ":"), rules[0])
    rules += [F.upper(found(low, p)) for p in (r"đáp án:\s*([a-d])", r"đáp án\s+([a-d])", r"chọn\s+([a-d])", r"lựa chọn\s+([a-d])", r"\b([a-d])\s*\.")]
    rules.append(F.when(first_line.rlike("^[A-Da-d]$"), F.upper(first_line)))
    rules += [F.when(F.contains(last, F.lit(f"[{o}]")) | F.contains(last, F.lit(f"đáp án {o}")), o.upper()) for o in "abcd"]
    return F.coalesce(*rules)


def truth(x: Column) -> Column:
    """True, false or no data, by the first rule that applies; null if none does."""
    low, first_line = F.lower(x), F.trim(F.split_part(x, F.lit("\n"), F.lit(1)))
    last = F.lower(F.right(x, F.lit(300)))
    said = F.coalesce(*[found(low, rf"{p}\s*(đúng|sai|không có dữ kiện)") for p in ("đáp án:", "câu trả lời là", "kết luận:")])
    yes, no = (F.contains(last, F.lit(w)) for w in ("đúng", "sai"))
    count = lambda w: F.size(F.regexp_extract_all(low, F.lit(w), 0))
    return F.coalesce(
        F.when(first_line.isin(C.TRUE_LABEL, C.FALSE_LABEL, C.NO_DATA_LABEL, "Không đủ thông tin"), first_line),
        F.when(said == "đúng", C.TRUE_LABEL).when(said == "sai", C.FALSE_LABEL).when(said.isNotNull(), C.NO_DATA_LABEL),
        F.when(yes & ~no, C.TRUE_LABEL).when(no & ~yes, C.FALSE_LABEL).when(F.contains(last, F.lit("không có dữ kiện")) | F.contains(last, F.lit("không đủ thông tin")), C.NO_DATA_LABEL),
        F.when(count("sai") > count("đúng"), C.FALSE_LABEL).when(count("đúng") > count("sai"), C.TRUE_LABEL),
    )


def variant_label(x: Column) -> Column:
    return F.when(x == "PARAPHRASE_HARD", "Paraphrase").when(x == "UNANSWERABLE", "Unanswerable").otherwise("Normal")


def unfenced(x: Column) -> Column:
    """A reply without its code fence."""
    return F.trim(F.regexp_replace(x, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def json_or_null(x: Column, schema: str) -> Column:
    """from_json, but null where the text isn't JSON."""
    return F.when(F.get_json_object(x, "$").isNotNull(), F.from_json(x, schema))


def parsed(x: Column, schema: str) -> Column:
    """JSON of a reply: as it is, without trailing commas, or the first balanced object in it."""
    t = unfenced(x)
    fixed = F.regexp_replace(t, r",\s*([}\]])", "$1")
    return F.coalesce(json_or_null(t, schema), json_or_null(fixed, schema), F.from_json(balanced_object(x), schema))


def first_object(text: str | None) -> str | None:
    """The first {...} of a text whose braces balance outside of strings."""
    if text is None:
        return None
    depth, start, quoted = 0, -1, False
    for m in re.finditer(r'\\.|["{}]', text):
        c = m.group()
        if c == '"' and depth:
            quoted = not quoted
        elif c == "{" and not quoted:
            start = m.start() if not depth else start
            depth += 1
        elif c == "}" and depth and not quoted:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


@F.pandas_udf(T.StringType())
def balanced_object(x: pd.Series) -> pd.Series:
    return x.map(first_object, na_action="ignore")


def similarity_match(a: str, b: str, threshold: float = 0.9) -> bool:
    from difflib import SequenceMatcher

    a, b = a.lower().strip(), b.lower().strip()
    return a == b or a in b or b in a or SequenceMatcher(None, a, b).ratio() >= threshold


def name_matches(a: Column, b: Column, threshold: float = 0.9) -> Column:
    """Equal, one inside the other, or a matching ratio of `threshold`; only pairs that need the ratio leave the JVM."""

    @F.pandas_udf(T.BooleanType())
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else similarity_match(p, q, threshold) for p, q in zip(x, y, strict=True)])

    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when((x == y) | F.contains(x, y) | F.contains(y, x), True).otherwise(ratio(a, b))
