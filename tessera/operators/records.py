"""Records of persons: (title, id, template, infobox map) and what becomes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import dates, text
from tessera.operators.graph import merged_text

SLOTS = 14


def normalized_keys(records: DataFrame) -> DataFrame:
    """Infoboxes by the usual field names; values of fields that come together are joined by "; "."""
    each = records.select("id", F.posexplode("infobox").alias("pos", "k", "v")).select("id", "pos", text.infobox_key(F.col("k")).alias("key"), F.trim("v").alias("v"))
    one = each.groupBy("id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vs"), F.min("pos").alias("pos"))
    entries = one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("key"), merged_text(F.col("vs")).alias("value")))).alias("e"))
    boxes = entries.select("id", F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], x["value"]))).alias("_box"))
    return records.join(boxes, "id", "left").withColumn("infobox", F.coalesce("_box", "infobox")).drop("_box")


def cleaned(records: DataFrame) -> DataFrame:
    """Records with a title and an infobox of text fields: "|k=v" that leaked into a value becomes a field, later ones win; dates are normalized; empty fields go."""
    pairs = F.flatten(F.transform(F.map_entries("infobox"), _leaked))
    box = F.map_from_entries(_last_wins(pairs))
    box = F.transform_values(box, lambda _, v: text.strip_markup(v))
    box = F.transform_values(box, lambda k, v: F.when(dates.is_date_key(k), dates.normalized(v)).otherwise(v))
    out = records.where("title is not null and title <> '' and infobox is not null").withColumn("infobox", F.map_filter(box, lambda _, v: v != ""))
    return out.where(F.size("infobox") > 0)


def _leaked(e: Column) -> Column:
    """A field's own value up to the first bar outside of links and templates, and the k=v parts after it."""
    parts = F.split(e["value"], r"\|(?![^\[]*\]\])(?![^{]*\}\})")
    own = F.array(F.struct(e["key"].alias("k"), F.trim(parts[0]).alias("v")))
    rest = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(r"^\s*[^=\s][^=]*="))
    return F.concat(own, F.transform(rest, lambda p: F.struct(text.infobox_key(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"))))


def _last_wins(pairs: Column) -> Column:
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))


def with_provinces(records: DataFrame, fields: tuple[str, ...] = ("birth_place", "hometown", "residence")) -> DataFrame:
    """Places become provinces where one is recognized."""
    place = lambda v: F.coalesce(F.nullif(text.province(v), F.lit("")), v)
    return records.withColumn("infobox", F.transform_values("infobox", lambda k, v: F.when(k.isin(*fields), place(v)).otherwise(v)))


def with_lists(records: DataFrame) -> DataFrame:
    """awards, education, alma_mater, battles, party as arrays beside the infobox; null where nothing is left."""
    some = lambda a: F.when(F.size(a) > 0, a)
    of = lambda k: F.col("infobox")[k]
    return records.withColumns({"awards": some(text.split_awards(of("awards"))), "education": some(text.split_list(of("education"))), "alma_mater": some(text.split_list(of("alma_mater"))), "battles": some(text.split_list(of("battles"))), "party": some(text.split_parties(of("party")))})


def overlay_dates(normalized: DataFrame, raw: DataFrame, this_year: int) -> DataFrame:
    """birth_date and death_date as the raw records' templates have them, where they are valid, over the normalized ones."""
    new = raw.select("title", "id", *[dates.valid(dates.from_template(F.col("infobox")[k], this_year)).alias(f"_{k}") for k in ("birth_date", "death_date")])
    both = normalized.join(new, ["title", "id"], "left")
    for k in ("birth_date", "death_date"):
        both = both.withColumn("infobox", F.when(F.col(f"_{k}").isNotNull(), F.map_concat(F.map_filter("infobox", _not(k)), F.create_map(F.lit(k), F.col(f"_{k}")))).otherwise(F.col("infobox")))
    return both.drop("_birth_date", "_death_date")


def _not(key: str):
    return lambda k, _: k != key


def with_summaries(records: DataFrame, pages: DataFrame) -> DataFrame:
    """summary: the lead of the page of the same title; '' without one. pages: title, text."""
    wanted = pages.join(records.select("title").distinct(), "title", "left_semi")
    leads = wanted.groupBy("title").agg(F.max_by("text", F.length("text")).alias("text")).select("title", text.summary_of(F.col("text"), F.col("title")).alias("summary"))
    return records.join(leads, "title", "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def slots(records: DataFrame) -> DataFrame:
    """record_id, slot 1 to 14, office, term_start, term_end, predecessor, successor: the numbered offices of each record."""
    field = lambda k, i: F.col("infobox")[k if i == 1 else f"{k}{i}"].alias(k)
    each = [F.struct(F.lit(i).alias("slot"), *[field(k, i) for k in ("office", "term_start", "term_end", "predecessor", "successor")]) for i in range(1, SLOTS + 1)]
    return records.select(F.col("id").alias("record_id"), F.inline(F.array(*each))).where("office is not null and office <> ''")


def mentions(records: DataFrame) -> DataFrame:
    """record_id, edge, label, name, properties, ord: every value of a record that is a node, in the order of its fields. Expects with_lists().

    A field is read under its other names too, the first that is there; awards of the infobox count where there is no list of them.
    """
    plain = lambda x: text.strip_value_markup(x)
    none = F.expr("cast(map() as map<string,string>)")
    office = slots(records)
    terms = F.map_filter(F.create_map(F.lit("term_start"), plain(F.col("term_start")), F.lit("term_end"), plain(F.col("term_end")), F.lit("status"), text.office_status(F.col("office"))), lambda _, v: v != "")
    out = office.select("record_id", F.lit("SERVED_AS").alias("edge"), F.lit("Position").alias("label"), plain(F.col("office")).alias("name"), terms.alias("properties"), F.col("slot").alias("ord"))
    box = F.col("infobox")
    field = lambda *names: F.coalesce(*[box[k] for k in names])
    none_of = F.array().cast("array<string>")
    lines = lambda k: F.coalesce(F.split(box[k], "<br>"), none_of)
    years = text.service_years(plain(F.coalesce(field("serviceyears", "years_of_service", "năm_phục_vụ"), F.lit(""))))
    service = F.map_filter(F.create_map(F.lit("year_start"), years["year_start"].cast("string"), F.lit("year_end"), years["year_end"].cast("string")), lambda _, v: v.isNotNull())
    singles = [("BORN_AT", "Location", field("birth_place", "nơi_sinh"), none, 100), ("DIED_AT", "Location", field("death_place", "nơi_chết"), none, 101), ("SERVED_IN", "MilitaryCareer", box["branch"], service, 300), ("HAS_RANK", "MilitaryRank", F.when(box["branch"].isNotNull(), field("rank", "military_rank", "cấp_bậc")), none, 301)]
    row = lambda edge, label, name, props, at: F.struct(F.lit(edge).alias("edge"), F.lit(label).alias("label"), name.alias("name"), props.alias("properties"), at.alias("ord"))
    every = [F.array(*[row(edge, label, plain(value), props, F.lit(at)) for edge, label, value, props, at in singles])]
    awards = F.when(F.size("awards") > 0, F.col("awards")).otherwise(F.array(box["awards"], box["giải_thưởng"], box["khen_thưởng"]))
    schools = F.concat(F.coalesce("alma_mater", none_of), lines("trường"), lines("nơi_đào_tạo"))
    titles = F.coalesce(F.col("education"), lines("trình_độ"))
    many = [("AWARDED", "Award", awards, 200), ("FOUGHT_IN", "Campaigns", F.col("battles"), 400), ("ALUMNUS_OF", "AlmaMater", schools, 500), ("HAS_ACADEMIC_TITLE", "AcademicTitle", titles, 600), ("HAS_ACADEMIC_TITLE", "AcademicTitle", F.split(box["honorific_prefix"], ","), 700)]
    listed = lambda edge, label, values, at: F.transform(F.coalesce(values, none_of), lambda v, i: row(edge, label, F.trim(plain(v)), none, F.lit(at * 1000) + i))
    every += [listed(*x) for x in many]
    out = out.unionByName(records.select(F.col("id").alias("record_id"), F.inline_outer(F.concat(*every))))  # all but the offices in one pass; inline would make them twice, for a filter
    return out.where("name is not null and name <> ''")


def persons(records: DataFrame) -> DataFrame:
    """A node for each record: the first of a title; the party is the usual one where none is given."""
    box, plain = F.col("infobox"), text.strip_value_markup
    props = F.create_map(F.lit("birth_date"), plain(box["birth_date"]), F.lit("death_date"), plain(box["death_date"]), F.lit("party"), F.coalesce(F.nullif(F.array_join("party", "; "), F.lit("")), F.lit(C.DEFAULT_PARTY)))
    keyed = records.where("title <> ''").withColumn("name_key", text.name_key(F.col("title")))
    node = F.struct(F.col("id").alias("record_id"), F.concat(F.lit("pol"), F.col("id").cast("string")).alias("id"), F.coalesce(F.nullif(plain(box["name"]), F.lit("")), plain(F.col("title"))).alias("name"), props.alias("properties"))
    return keyed.groupBy("name_key").agg(F.min_by(node, F.col("id")).alias("n")).select("n.record_id", "n.id", F.lit("Politician").alias("type"), "n.name", "n.properties", "name_key")


def extraction_filter(rows: DataFrame) -> DataFrame:
    """Entities and relations of the allowed types; rows: question, answer_json{entities[{text,type}], intent_relation[]}."""
    kept = F.struct(
        F.filter(F.col("answer_json.entities"), lambda e: e["type"].isin(C.ALLOWED_ENTITY_TYPES)).alias("entities"),
        F.filter(F.col("answer_json.intent_relation"), lambda r: r.isin(C.ALLOWED_RELATION_TYPES)).alias("intent_relation"),
    )
    return rows.drop("id").withColumn("answer_json", kept)


def path_entities(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """What an extraction of each path should be: its nodes (text, type), each once, and its relations without repeats in a row. rows: id, path."""
    each = rows.select("id", F.posexplode("path").alias("pos", "x")).where("pos % 2 = 0")
    found = each.join(nodes.select(F.col("id").alias("x"), "name", "type"), "x")
    entities = found.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("name").alias("text"), "type"))), lambda e: F.struct(e["text"], e["type"]))).alias("entities"))
    rels = text.path_relations(F.col("path"))
    once = F.filter(rels, lambda x, i: (i == 0) | (x != F.get(rels, i - 1)))
    return rows.select("id", once.alias("intent_relation")).join(entities, "id", "left")


def with_days(rows: DataFrame, columns: list[str], this_year: int) -> DataFrame:
    """rows with each column's date template or text as YYYY-MM-DD, null where it names no day that exists."""
    return rows.withColumns({c: dates.valid(dates.from_template(F.col(c), this_year)) for c in columns})


def day_counts(rows: DataFrame, columns: list[str], this_year: int) -> DataFrame:
    """column, normalized, failed, absent: in how many rows a column gives a day, names one that doesn't exist, or names none. One pass over all columns."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("said")) for c in columns])
    found = rows.select(F.inline(each)).select("column", dates.from_template(F.col("said"), this_year).alias("date")).select("column", F.col("date").isNotNull().alias("named"), dates.valid(F.col("date")).isNotNull().alias("is_day"))
    n = lambda c: F.count_if(c)
    return found.groupBy("column").agg(n(F.col("is_day")).alias("normalized"), n(F.col("named") & ~F.col("is_day")).alias("failed"), n(~F.col("named")).alias("absent"))
