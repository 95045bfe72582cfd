"""Texts from a node's edges: a biography in sections, and a sentence for each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import PropertyGraph, named

#: Sections of a biography in order: edge type, words before, between and after.
SECTIONS = [
    ("SERVED_AS", "Các chức vụ từng đảm nhiệm: ", "; "), ("BORN_AT", "Sinh tại ", ", "), ("DIED_AT", "Mất tại ", ", "), ("ALUMNUS_OF", "Tốt nghiệp tại: ", ", "),
    ("HAS_ACADEMIC_TITLE", "Học hàm/học vị: ", ", "), ("SERVED_IN", "Từng phục vụ tại: ", ", "), ("HAS_RANK", "Cấp bậc: ", ", "), ("AWARDED", "Giải thưởng/Huân chương: ", ", "),
    ("FOUGHT_IN", "Tham gia chiến dịch: ", ", "), ("SUCCEEDED", "Kế nhiệm: ", ", "), ("PRECEDED", "Tiền nhiệm: ", ", "),
]

#: Edge type, words between the names, then (property, words before it).
SENTENCES = {
    "SERVED_AS": (" giữ chức ", [("term_start", " từ "), ("term_end", " đến "), ("status", ". Trạng thái: "), ("reason", ". Lý do: ")]),
    "PRECEDED": (" là người tiền nhiệm của ", [("position_id", " trong chức vụ có id ")]),
    "SUCCEEDED": (" là người kế nhiệm của ", [("position_id", " trong chức vụ có id ")]),
    "BORN_AT": (" sinh tại ", []), "DIED_AT": (" mất tại ", []), "AWARDED": (" được trao tặng ", []), "SERVED_IN": (" phục vụ trong ", [("year_start", " từ "), ("year_end", " đến ")]),
    "ALUMNUS_OF": (" là cựu sinh viên của ", []), "HAS_ACADEMIC_TITLE": (" có học vị ", []), "HAS_RANK": (" có cấp bậc ", []), "FOUGHT_IN": (" tham gia chiến dịch ", []),
}


def _prop(k: str) -> Column:
    return F.nullif(F.col("properties")[k], F.lit(""))


def detail() -> Column:
    """What a section says beside the target's name."""
    both = F.concat(F.coalesce(_prop("term_start"), F.lit("")), F.lit(" - "), F.coalesce(_prop("term_end"), F.lit("")))
    parts = F.concat_ws(", ", F.when(_prop("term_start").isNotNull() | _prop("term_end").isNotNull(), both), F.concat(F.lit("trạng thái: "), _prop("status")), F.concat(F.lit("lý do: "), _prop("reason")))
    years = F.concat(F.coalesce(_prop("year_start"), F.lit("None")), F.lit("-"), F.coalesce(_prop("year_end"), F.lit("None")))
    return (
        F.when(F.col("type") == "SERVED_AS", F.nullif(parts, F.lit("")))
        .when((F.col("type") == "SERVED_IN") & (_prop("year_start").isNotNull() | _prop("year_end").isNotNull()), years)
        .when(F.col("type") == "AWARDED", _prop("year"))
    )


def biographies(graph: PropertyGraph, label: str = "Politician") -> DataFrame:
    """id, summary: an opening from the node's properties and a section for each kind of edge it has."""
    p = lambda k: F.nullif(F.col("properties")[k], F.lit(""))
    opening = F.concat(F.concat_ws(", ", F.concat("name", F.lit(" là một chính trị gia Việt Nam")), F.concat(F.lit("sinh ngày "), p("birth_date")), F.concat(F.lit("mất ngày "), p("death_date")), F.concat(F.lit("thuộc "), p("party"))), F.lit("."))
    people = graph.nodes.where(F.col("type") == label).select("id", opening.alias("opening"))
    item = F.concat("dst_name", F.coalesce(F.concat(F.lit(" ("), detail(), F.lit(")")), F.lit("")))
    said = named(graph).where("dst_name <> ''").select(F.col("src").alias("id"), "type", "ord", item.alias("item"))
    lists = said.groupBy("id", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]).alias("items"))
    line = F.when(F.lit(False), "")
    rank = F.when(F.lit(False), 0)
    for i, (kind, before, between) in enumerate(SECTIONS):
        line = line.when(F.col("type") == kind, F.concat(F.lit(before), F.array_join("items", between), F.lit(".")))
        rank = rank.when(F.col("type") == kind, i)
    parts = lists.select("id", rank.alias("rank"), line.alias("line")).where("line is not null").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    return people.join(parts, "id", "left").select("id", F.concat_ws(" ", "opening", F.array_join("lines", " ")).alias("summary"))


def relation_chunks(graph: PropertyGraph, sentences: dict | None = None) -> DataFrame:
    """relation_type, source_id, target_id, text: each edge as a sentence."""
    text = F.when(F.lit(False), "")
    for kind, (between, extras) in (sentences or SENTENCES).items():
        tail = [F.coalesce(F.concat(F.lit(w), _prop(k)), F.lit("")) for k, w in extras]
        text = text.when(F.col("type") == kind, F.concat(F.lit(f"Quan hệ {kind}: "), F.coalesce("src_name", F.lit("")), F.lit(between), F.coalesce("dst_name", F.lit("")), *tail))
    return named(graph).select(F.col("type").alias("relation_type"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), text.alias("text")).where("text is not null")
