"""Dates in texts. Ladders: the first pattern that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import found

#: Patterns of dates in texts, each with the groups of year, month and day.
TEXT_DATES = [
    (r"(?:ngày\s+)?(\d{1,2})\s+tháng\s+(\d{1,2})(?:,\s*|\s+năm\s+)(\d{4})", (3, 2, 1)),
    (r"tháng\s+(\d{1,2})(?:,\s*|\s+năm\s+)(\d{4})", (2, 1)),
    (r"^(\d{4})-(\d{2})-(\d{2})$", (1, 2, 3)),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", (3, 2, 1)),
    (r"^\s*(\d{4})\s*$", (1,)),
]
#: The same in date templates; the last one is a year alone.
TEMPLATE_DATES = [
    (r"\{\{ngày\s+(?:sinh|chết|mất)\s+và\s+tuổi\|(\d{4})\|(\d{1,2})\|(\d{1,2})", (1, 2, 3)),
    (r"\{\{(?:birth|death)\s+date\s+and\s+age\|(?:df=yes\|)?(\d{4})\|(\d{1,2})\|(\d{1,2})", (1, 2, 3)),
    (r"\{\{(?:birth|death)\s+date\|(?:df=yes\|)?(\d{4})\|(\d{1,2})\|(\d{1,2})", (1, 2, 3)),
    (r"\{\{ngày\s+(?:sinh|chết|mất)\|(\d{4})\|(\d{1,2})\|(\d{1,2})", (1, 2, 3)),
    (r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", (3, 2, 1)),
    (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", (1, 2, 3)),
]
#: The keys of dates, a year that stands alone, and a year of birth.
DATE_KEY = r"(?iU)^(term_start\d*|term_end\d*|.*_date|.*date)$"
YEAR_ALONE = r"\{\{(\d{4})\}\}|\b(\d{4})\b"
BIRTH_YEAR = r"\b(18\d{2}|19\d{2}|20\d{2})\b"


def normalized(x: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD from the usual ways to write dates, without looking at the calendar; other texts stay."""
    t = F.trim(x)
    out = []
    for pattern, groups in TEXT_DATES:
        parts = [F.lpad(found(t, pattern, g, "iU"), 4 if i == 0 else 2, "0") for i, g in enumerate(groups)]
        out.append(F.when(parts[0].isNotNull(), F.concat_ws("-", *parts)))
    return F.coalesce(*out, t)


def is_date_key(x: Column) -> Column:
    return x.rlike(DATE_KEY)


def from_template(x: Column, this_year: int) -> Column:
    """struct(y, m, d) of a date template or text; a year alone counts from 1900 to this_year, as its first day."""
    out = []
    for pattern, (y, m, d) in TEMPLATE_DATES:
        part = lambda g, pattern=pattern: found(x, pattern, g, "iU").cast("int")
        out.append(F.when(part(y).isNotNull(), F.struct(part(y).alias("y"), part(m).alias("m"), part(d).alias("d"))))
    year = F.coalesce(found(x, YEAR_ALONE, 1), found(x, YEAR_ALONE, 2)).cast("int")
    out.append(F.when(year.between(1900, this_year), F.struct(year.alias("y"), F.lit(1).alias("m"), F.lit(1).alias("d"))))
    return F.coalesce(*out)


def valid(date: Column) -> Column:
    """YYYY-MM-DD of struct(y, m, d); null for days that don't exist."""
    day = lambda x: F.when(x.isNotNull(), F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"]), "yyyy-MM-dd"), "yyyy-MM-dd"))
    return F.get(F.transform(F.array(date), day), F.lit(0))  # the date's ladder is in the plan once


def birth_year(x: Column) -> Column:
    return found(x, BIRTH_YEAR).try_cast("int")


def first_year(x: Column) -> Column:
    """The first four digits."""
    return found(x, r"(\d{4})").try_cast("int")


def iso_year(x: Column, low: int, high: int) -> Column:
    """The year before the first hyphen if it is plausible."""
    y = F.split_part(x, F.lit("-"), F.lit(1)).try_cast("int")
    return F.when(y.between(low, high), y)


def duration_label(start: Column, end: Column, both: bool = True) -> Column:
    """"from A to B"; with both=False one of them is enough."""
    s, e = (F.nullif(F.trim(c), F.lit("")) for c in (start, end))
    whole = F.concat(F.lit("từ "), s, F.lit(" đến "), e)
    return whole if both else F.coalesce(whole, F.concat(F.lit("từ "), s), F.concat(F.lit("đến "), e))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def jitter(year: Column, key: Column, spread: int) -> Column:
    """A year up to `spread` off, never the same, by the key."""
    off = F.pmod(F.xxhash64(key), F.lit(2 * spread)) - spread
    return (year + off + F.when(off >= 0, 1).otherwise(0)).cast("int")
