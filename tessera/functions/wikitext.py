"""Templates of wikitext and lists of pages, by small scanners in Arrow batches: nesting is beyond regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import constants as C

_MARK = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def templates(text: str) -> Iterator[tuple[int, str]]:
    """Start and inside of all templates, outer ones before those in them."""
    found, stack = [], []
    for m in re.finditer(r"\{\{|\}\}", text):
        if m.group() == "{{":
            stack.append(m.start())
        elif stack:
            found.append((start := stack.pop(), text[start + 2 : m.start()]))
    yield from sorted(found)


def arguments(inside: str) -> list[str]:
    """A template's name and arguments: cut at bars outside of links and inner templates."""
    out, depth, at = [], 0, 0
    for m in _MARK.finditer(inside):
        mark = m.group()
        if mark in ("{{", "[["):
            depth += 1
        elif mark in ("}}", "]]"):
            depth = max(0, depth - 1)
        elif not depth:
            out.append(inside[at : m.start()])
            at = m.end()
    return [*out, inside[at:]]


def infobox_of(text: str | None) -> tuple[str, dict[str, str]]:
    """The template that comes first by priority, else the first that is called an infobox; NOT_FOUND without one."""
    parts = [arguments(t) for _, t in templates(text or "")]
    names = [p[0].strip() for p in parts]
    chosen = next((i for want in C.PRIORITY_TEMPLATES for i, n in enumerate(names) if n == want), None)
    if chosen is None:
        box = lambda n: any(w in n for w in C.TEMPLATE_WORDS) and not any(w in n for w in C.TEMPLATE_NOT)
        chosen = next((i for i, n in enumerate(names) if box(n.lower())), None)
    if chosen is None:
        return "NOT_FOUND", {}
    values, place = {}, 0
    for a in parts[chosen][1:]:
        key, eq, value = a.partition("=")
        if not eq:
            place += 1
            key, value = str(place), a
        if key.strip() and value.strip():
            values[key.strip()] = value.strip()
    return names[chosen], values


@F.pandas_udf(T.StructType([T.StructField("template", T.StringType()), T.StructField("infobox", T.StringType())]))
def _infobox(text: pd.Series) -> pd.DataFrame:
    import json

    found = [infobox_of(t) for t in text]
    return pd.DataFrame({"template": [t for t, _ in found], "infobox": [json.dumps(b, ensure_ascii=False) for _, b in found]})


def infobox(text):
    """struct(template, infobox map) of wikitext."""
    x = _infobox(text)
    return F.struct(x["template"].alias("template"), F.from_json(x["infobox"], "map<string,string>").alias("infobox"))


class _Names(HTMLParser):
    """Links in the second column of outermost wikitables and first links of items of outermost ordered lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.lists, self.column, self.names = [], 0, 0, []
        self.cell: list[str] | None = None
        self.broken, self.item = False, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.tables.append("wikitable" in (a.get("class") or ""))
        elif tag == "tr" and self.tables:
            self.column = 0
        elif tag in ("td", "th") and self.tables:
            self.column += 1
            if self.column == 2 and self.tables[0]:
                self.cell, self.broken = [], False
        elif tag in ("br", "p") and self.cell is not None:
            self.broken = True
        elif tag == "ol":
            self.lists += 1
        elif tag == "li" and self.lists == 1:
            self.item = True
        elif tag == "a" and a.get("href"):
            if self.cell is not None:
                self.cell.append(a["href"])
            elif self.item:
                self.names.append(a["href"])
                self.item = False

    def handle_endtag(self, tag):
        if tag == "table" and self.tables:
            self.tables.pop()
        elif tag in ("td", "th") and self.cell is not None:
            if len(self.cell) == 1 or (self.cell and self.broken):
                self.names += self.cell if self.broken else self.cell[:1]
            self.cell = None
        elif tag == "ol":
            self.lists = max(0, self.lists - 1)
        elif tag == "li":
            self.item = False


@F.pandas_udf(T.ArrayType(T.StringType()))
def list_links(html: pd.Series) -> pd.Series:
    def one(text: str | None) -> list[str]:
        p = _Names()
        p.feed(text or "")
        p.close()
        return p.names

    return html.map(one)
