"""Queries of text, date and record functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import answers, dates, text, wikitext
from tessera.operators import names, patterns, records
from tessera.operators.graph import merged_text
from tessera.plans.tables import E, N, graph, query, read


@query(r"""
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type
""")
def src_events_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


def _without(x: str, kinds: list[str], by: str = "") -> str:
    """SQL that replaces each of these kinds of markup in turn."""
    for kind in kinds:
        pattern = C.MARKUP[kind].replace("'", "''")
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_FIELD = _without(_without(_without("html", ["template", "reference", "short reference", "size", "layout and bar", "media", "address", "media link"]), ["link"], r"\1"), ["break or bullet"], ", ")


@query(f"""
WITH a AS (SELECT page_id, trim(regexp_replace({_without(_FIELD, ["tag"])}, '\\s+', ' ', 'g')) AS x FROM pages),
b AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(x, ',\\s*,+', ',', 'g'), '\\s*,\\s*', ', ', 'g'), '''''', ''), '||', '') AS x FROM a)
SELECT page_id, length(trim(x, ', ')) AS n_chars, md5(trim(x, ', ')) AS digest FROM b
""")
def txt_strip_markup(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "pages").select("page_id", text.strip_markup(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").alias("n_chars"), F.md5("x").alias("digest"))


#: Pages with nested templates in them, as deep as their number says.
_NESTED = "replace(html, '<p>', repeat('{{a|', 1 + page_id % 40) || repeat('}}', 1 + page_id % 40) || ' [[' || page_id || '|<p>')"


@query(f"""
WITH RECURSIVE t AS (
  SELECT page_id, {_without(_NESTED, ["summary media", "any reference", "closed reference", "comment", "tag"])} AS x, 0 AS i FROM pages
  UNION ALL SELECT page_id, regexp_replace(x, '{C.MARKUP["innermost template"]}', '', 'g'), i + 1 FROM t WHERE regexp_matches(x, '{C.MARKUP["innermost template"]}')),
u AS (SELECT page_id, arg_max(x, i) AS x FROM t GROUP BY page_id),
v AS (SELECT page_id, {_without(_without(_without("x", ["summary link"], r"\1"), ["labelled address"], r"\1"), ["bare address"])} AS x FROM u),
w AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '''{{2,}}', '', 'g'), '\\n\\n+', '. ', 'g'), '\\s+', ' ', 'g'), '\\.\\s*\\.+', '.', 'g'), '"', '') AS x FROM v)
SELECT page_id, md5(trim(x)) AS digest FROM w
""")
def txt_clean_summary(spark: SparkSession, d: str) -> DataFrame:
    depth = (F.lit(1) + F.col("page_id") % 40).cast("int")
    nested = F.replace("html", F.lit("<p>"), F.concat(F.repeat(F.lit("{{a|"), depth), F.repeat(F.lit("}}"), depth), F.lit(" [["), F.col("page_id").cast("string"), F.lit("|<p>")))
    return read(spark, d, "pages").select("page_id", F.md5(text.clean_summary(nested)).alias("digest"))


@query(r"""
WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(trim(text), '[,;]\s*|<br\s*/?\s*>|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS l FROM documents),
k AS (SELECT doc_id, list_filter(l, lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[\d\s.\-:;,]+')) AS l FROM p),
u AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM k),
f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x),
g AS (SELECT doc_id, count(*) AS n_items, md5(string_agg(x, '|' ORDER BY i)) AS digest FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_items, 0) AS n_items, coalesce(g.digest, md5('')) AS digest FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
""")
def txt_split_list(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "documents").select("doc_id", text.split_list(F.col("text")).alias("l"))
    return x.select("doc_id", F.size("l").alias("n_items"), F.md5(F.array_join("l", "|")).alias("digest"))


@query(r"""
SELECT lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS name_key, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1
""")
def txt_name_keys(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy(text.name_key(F.col("p_name")).alias("name_key")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query(r"""
SELECT field, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'office' || p_size WHEN 1 THEN replace(lower(p_type), ' ', '_') || '_' || replace(p_name, ' ', '_') || p_size WHEN 2 THEN 'birth_date' ELSE replace(replace(lower(p_brand), '#', '#'), ' ', '_') END AS field
FROM (SELECT *, regexp_replace(p_brand, '\d+$', '') AS b FROM part)) GROUP BY field
""")
def txt_infobox_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("chức vụ "), F.col("p_size"))).when(k == 1, F.concat_ws(" ", F.concat_ws("-", "p_type", "p_name"), F.col("p_size").cast("string"))).when(k == 2, F.lit("Ngày sinh")).otherwise(F.col("p_brand"))
    return read(spark, d, "part").groupBy(text.infobox_key(raw).alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT page_id, CASE WHEN x LIKE '#cite%' OR regexp_full_match(x, '\d+') THEN NULL ELSE x END AS name
FROM (SELECT page_id, replace(url_decode(replace(regexp_replace(url, '^https?://[^/]+', ''), '/wiki/', '')), '_', ' ') AS x FROM pages)
""")
def txt_page_names(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", text.page_name(F.regexp_replace("url", r"^https?://[^/]+", "")).alias("name"))


@query(r"""
SELECT page_id, len(l) AS n_links, array_to_string(l, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
""")
def src_page_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)
    return read(spark, d, "pages").select("page_id", found.alias("l")).select("page_id", F.size("l").alias("n_links"), F.array_join("l", " ").alias("links"))


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, 'Row ' || page_id AS name FROM pages UNION ALL SELECT page_id, 'Item ' || i FROM l CROSS JOIN range(3) r(i) WHERE i < len(l)
""")
def src_list_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a table and an ordered list put before their text: as many items as the page has links, three at most."""
    n = F.least(F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)), F.lit(3))
    cell = F.concat(F.lit('<table class="wikitable"><tr><td><a href="/wiki/No">1</a></td><td><a href="/wiki/Row_'), F.col("page_id").cast("string"), F.lit('">x</a></td></tr></table><ol>'))
    items = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < n), lambda i: F.concat(F.lit('<li><b><a href="/wiki/Item_'), i.cast("string"), F.lit('">y</a></b> and <a href="/wiki/No">z</a></li>'))), "")
    page = F.concat(cell, items, F.lit("</ol>"), "html")
    return read(spark, d, "pages").select("page_id", F.explode(wikitext.list_links(page)).alias("href")).select("page_id", text.page_name(F.col("href")).alias("name"))


@query(r"""
SELECT p_partkey, p_name || '|' || p_type AS targets, p_name AS label FROM part
""")
def txt_link_targets(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    link = F.concat(F.lit("[["), "p_name", F.lit("|x]] [[File:a.png]] [["), "p_type", F.lit("]] [[vacant]]"))
    label = F.concat(F.lit("<b>[["), "p_type", F.lit("|"), "p_name", F.lit("]]</b>"))
    return p.select("p_partkey", F.array_join(text.link_targets(link, distinct=False), "|").alias("targets"), text.link_label(label).alias("label"))


@query(r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '<[^>]+>', '', 'g'), ' ') AS x FROM conversations),
p AS (SELECT conv_id, turn, list_filter(list_transform(CASE WHEN contains(x, ',') THEN string_split(x, ',') WHEN contains(x, ';') THEN string_split(x, ';') WHEN contains(x, chr(10)) THEN string_split(x, chr(10)) ELSE [x] END, lambda y: trim(y, ' ')), lambda y: y <> '') AS l FROM c)
SELECT conv_id, turn, len(l) AS n, md5(array_to_string(l, '|')) AS digest FROM p
""")
def txt_plain_names(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "conversations").select("conv_id", "turn", text.plain_names(F.col("text")).alias("l"))
    return x.select("conv_id", "turn", F.size("l").alias("n"), F.md5(F.array_join("l", "|")).alias("digest"))


#: Samples of the domain's texts: what each function makes of its text.
_CASES = [
    ("province", "xã A, Hải Hưng", "Hải Dương"), ("province", "Hà Đông", "Hà Nội"), ("province", "Paris", ""), ("province", "tỉnh Quảng Nam cũ", "Quảng Nam"),
    ("status", "Bộ trưởng, bị cách chức, miễn nhiệm", "bị cách chức"), ("status", "từ chức năm 1990", "miễn nhiệm"), ("status", "Chủ tịch", ""),
    ("party", "ĐCSVN", "Đảng Cộng sản Việt Nam"), ("party", "bị khai trừ năm 1990", "Đã bị khai trừ khỏi Đảng"), ("party", "Không; Đảng X", "Không đảng phái|Đảng X"),
    ("awards", "Huân chương Sao vàng hạng I, II", "Huân chương Sao vàng hạng I|Huân chương Sao vàng hạng II"), ("awards", "Medal Z (3)", "Medal Z"), ("awards", ". Anh hùng, hạng", "Anh hùng"),
    ("list", "A1 x, A1  x; 12; bc", "A1 x"), ("years", "1960 - 1975", "1960-1975"), ("years", "1960 – nay", "1960-"), ("local", "Paris, Pháp", "false"), ("local", "Hà Nội, Pháp", "true"), ("local", "Xyz", "true"),
    ("template", "infobox officeholder", "true"), ("template", "infobox company person", "false"), ("ignored", "Đương nhiệm ", "true"), ("ignored", "Nguyễn", "false"),
]


@query("SELECT s.s_suppkey, v.kind, v.result FROM supplier s JOIN (VALUES " + ", ".join(f"({i}, '{k}', '{r}')" for i, (k, _, r) in enumerate(_CASES)) + f") v(i, kind, result) ON s.s_suppkey % {len(_CASES)} = v.i")
def txt_domain_values(spark: SparkSession, d: str) -> DataFrame:
    cases = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(_CASES)], "i int, kind string, text string")
    rows = read(spark, d, "supplier").join(F.broadcast(cases), F.col("s_suppkey") % len(_CASES) == F.col("i"))  # the cases above
    t, years = F.col("text"), text.service_years(F.col("text"))
    yes = lambda c: c.cast("string")
    forms = {"province": text.province(t), "status": text.office_status(t), "party": F.array_join(text.split_parties(t), "|"), "awards": F.array_join(text.split_awards(t), "|"), "list": F.array_join(text.split_list(t), "|"), "years": F.concat(years["year_start"].cast("string"), F.lit("-"), F.coalesce(years["year_end"].cast("string"), F.lit(""))), "local": yes(text.is_local(t)), "template": yes(text.is_person_template(t)), "ignored": yes(text.ignored(t))}
    out = F.when(F.lit(False), "")
    for kind, x in forms.items():
        out = out.when(F.col("kind") == kind, x)
    return rows.select("s_suppkey", "kind", out.alias("result"))


_WORD_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_PERSON_PLACES = f"""
WITH c AS (SELECT c_custkey, {_WORD_LIST(C.LOCAL_WORDS)}[c_custkey % {len(C.LOCAL_WORDS)} + 1] AS here, {_WORD_LIST(C.FOREIGN_WORDS)}[c_custkey % {len(C.FOREIGN_WORDS)} + 1] AS there, c_nationkey AS k FROM customer)"""


@query(f"""{_PERSON_PLACES},
b AS (SELECT c_custkey, CASE WHEN k % 4 = 0 THEN here || 'x, ' || there WHEN k % 4 = 1 THEN there || ' – (' || upper(here) || ')' WHEN k % 4 = 2 THEN 'Xã ' || c_custkey ELSE 'Bx ' || here || ' ' || there END AS place, k FROM c),
s AS (SELECT c_custkey, ' ' || regexp_replace(lower(place), '[,()–-]+', ' ', 'g') || ' ' AS t FROM b)
SELECT c_custkey, CASE WHEN len(list_filter({_WORD_LIST([w.replace("-", " ").replace("   ", "  ") for w in C.LOCAL_WORDS])}, lambda w: contains(regexp_replace(t, ' +', ' ', 'g'), ' ' || regexp_replace(w, ' +', ' ', 'g') || ' '))) > 0 THEN true
  WHEN len(list_filter({_WORD_LIST(C.FOREIGN_WORDS)}, lambda w: contains(t, ' ' || w || ' '))) > 0 THEN false ELSE true END AS local FROM s
""")
def txt_local(spark: SparkSession, d: str) -> DataFrame:
    """Whether each customer is local by what its birth place and nationality say: all local and foreign words, in any case, whole or as part of a longer one."""
    n, m = len(C.LOCAL_WORDS), len(C.FOREIGN_WORDS)
    word = lambda words, k: F.array(*[F.lit(w) for w in words])[F.col("c_custkey").cast("int") % k]
    here, there, k = word(C.LOCAL_WORDS, n), word(C.FOREIGN_WORDS, m), F.col("c_nationkey") % 4
    place = F.when(k == 0, F.concat(here, F.lit("x, "), there)).when(k == 1, F.concat(there, F.lit(" – ("), F.upper(here), F.lit(")"))).when(k == 2, F.concat(F.lit("Xã "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("Bx "), here, F.lit(" "), there))
    field = F.when(F.col("c_custkey") % 3 == 0, "nơi_sinh").when(F.col("c_custkey") % 3 == 1, "nationality").otherwise("birth_place")
    return read(spark, d, "customer").select("c_custkey", text.is_local_person(F.create_map(field, place)).alias("local"))


_PLACES = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(C.PROVINCES))
_SPACED = r"' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


@query(f"""
WITH p(i, k, v) AS (VALUES {_PLACES}),
c AS (SELECT c_custkey, n_name || ', phường ' || p.k || ' cũ' AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN p ON p.i = ((c_custkey * 2654435761) % 4294967296) % {len(C.PROVINCES)}),
m AS (SELECT c_custkey, arg_min(p.v, p.i) AS province FROM c JOIN p ON contains({_SPACED.format('place')}, {_SPACED.format('k')}) GROUP BY c_custkey)
SELECT c_custkey, province FROM m
""")
def txt_provinces(spark: SparkSession, d: str) -> DataFrame:
    """Places of every customer that name one of all the places known."""
    from tessera.plans.tables import mixed

    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = F.array(*[F.lit(k) for k, _ in C.PROVINCES])
    place = F.concat("n_name", F.lit(", phường "), F.get(known, (mixed("c_custkey") % len(C.PROVINCES)).cast("int")), F.lit(" cũ"))
    # as many tasks as a shuffle has: a small file is read by one, and that has all the matching to do
    spread = c.select("c_custkey", place.alias("place")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.select("c_custkey", text.province(F.col("place")).alias("province"))


@query(r"""
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey % 9 AS n, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT o_orderkey, y AS year_start, CASE WHEN n < 8 THEN y + n END AS year_end, CASE WHEN p LIKE '1%' THEN 'bị cách chức' WHEN p LIKE '2%' OR p LIKE '3%' THEN 'miễn nhiệm' ELSE '' END AS status, s = 'F' AS ignored FROM o
""")
def txt_terms(spark: SparkSession, d: str) -> DataFrame:
    """Years of service, how an office ended and whether there was one, by the text that each order's columns make."""
    y = F.year("o_orderdate")
    o = read(spark, d, "orders")
    said = F.concat(y.cast("string"), F.when(F.col("o_custkey") % 2 == 0, " – ").otherwise("-"), F.when(F.col("o_custkey") % 9 < 8, (y + F.col("o_custkey") % 9).cast("string")).otherwise("nay"))
    p = F.col("o_orderpriority")
    ended = F.concat(p, F.when(p.startswith("1"), " Bị cách chức, từ chức").when(p.startswith("2"), " từ chức năm 1990").when(p.startswith("3"), " MIỄN NHIỆM").otherwise(" giữ chức"))
    years = text.service_years(said)
    office = F.when(F.col("o_orderstatus") == "F", " Đương nhiệm ").otherwise(p)
    return o.select("o_orderkey", years["year_start"].cast("bigint").alias("year_start"), years["year_end"].cast("bigint").alias("year_end"), text.office_status(ended).alias("status"), text.ignored(office).alias("ignored"))


@query(r"""
SELECT w.word, count(*) AS n, min(p_partkey) AS first FROM part p JOIN (VALUES ('RING'), ('hot'), ('Gear'), ('blue b'), ('zzz')) w(word) ON contains(lower(p.p_name), lower(w.word)) GROUP BY w.word
""")
def txt_contains(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([(w,) for w in ("RING", "hot", "Gear", "blue b", "zzz")], "word string")
    return patterns.column_search(read(spark, d, "part"), "p_name", words).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


@query("""
WITH q AS (SELECT p_partkey AS id, 'Which Brand sells a ' || p_name || ', ' || lower(p_type) || ' or ' || p_name || 's?' AS question FROM part),
n AS (SELECT DISTINCT p_name AS name, 'Part' AS type FROM part UNION SELECT DISTINCT p_type, 'Type' FROM part UNION SELECT DISTINCT p_type || ' or ' || split_part(p_name, ' ', 1), 'Both' FROM part UNION SELECT DISTINCT p_brand, 'Brand' FROM part UNION SELECT 'brand SELLS a', 'Brand')
SELECT q.id, n.name, n.type FROM q JOIN n ON contains(' ' || regexp_replace(lower(question), '[^a-z0-9#]+', ' ', 'g') || ' ', ' ' || lower(n.name) || ' ')
""")
def jon_names_standing(spark: SparkSession, d: str) -> DataFrame:
    """Which names stand in questions: names of one to three words, many of which begin with the same word."""
    p = read(spark, d, "part")
    q = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Which Brand sells a "), "p_name", F.lit(", "), F.lower("p_type"), F.lit(" or "), "p_name", F.lit("s?")).alias("question"))
    named = [("p_name", "Part"), ("p_type", "Type"), ("concat(p_type, ' or ', split_part(p_name, ' ', 1))", "Both"), ("p_brand", "Brand"), ("'brand SELLS a'", "Brand")]
    every = p.select(F.explode(F.array(*[F.struct(F.expr(x).alias("name"), F.lit(t).alias("type")) for x, t in named])).alias("n")).select("n.*").distinct()
    return names.standing(q, every)


@query("""
WITH w AS (SELECT DISTINCT substr(p_name, 2, 4) AS part FROM part UNION SELECT DISTINCT upper(p_type) FROM part UNION SELECT 'e')
SELECT t.text, w.part FROM (SELECT DISTINCT p_name || ' ' || lower(p_type) AS text FROM part) t JOIN w ON contains(lower(t.text), lower(w.part))
""")
def jon_contained(spark: SparkSession, d: str) -> DataFrame:
    """Which texts hold which parts, inside words too."""
    p = read(spark, d, "part")
    parts = p.select(F.explode(F.array(F.substr("p_name", F.lit(2), F.lit(4)), F.upper("p_type"), F.lit("e"))).alias("part"))
    return names.contained(p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("text")), parts)


@query()
def jon_similar_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts with their types, and the same with letters doubled or left out, that are alike in 0.9 (tested against all pairs)."""
    p = read(spark, d, "part")
    left = p.select(F.concat("p_name", F.lit(" of the kind "), F.lower("p_type")).alias("name"))
    right = p.select(F.concat(F.replace("p_name", F.lit("e"), F.lit("ee")), F.lit(" of a kind "), "p_type").alias("name"))
    return names.similar(left.distinct(), right.distinct(), 0.9)


_REPLIES = [
    ("mcq", "C. Lê Quang", "C"), ("mcq", "Tôi nghĩ là [b]", "B"), ("mcq", "Đáp án: d", "D"), ("mcq", "vì vậy chọn a", "A"), ("mcq", "b", "B"), ("mcq", "không rõ", None),
    ("tf", "Đúng", "Đúng"), ("tf", "Kết luận: sai", "Sai"), ("tf", "Có lẽ điều này là đúng", "Đúng"), ("tf", "không có dữ kiện nào", "Không có dữ kiện"), ("tf", "sai, đúng, sai", "Sai"), ("tf", "?", None),
    ("verdict", " đúng ", "Đúng"), ("verdict", "tôi KHÔNG đủ thông tin", "Không đủ thông tin"), ("verdict", "hmm", "Không xác định"),
]


@query("SELECT c.conv_id, c.turn, v.kind, v.answer FROM conversations c JOIN (VALUES " + ", ".join(f"({i}, '{k}', {'NULL' if r is None else repr(r)})" for i, (k, _, r) in enumerate(_REPLIES)) + f") v(i, kind, answer) ON (c.conv_id * 7 + c.turn) % {len(_REPLIES)} = v.i")
def txt_reply_answers(spark: SparkSession, d: str) -> DataFrame:
    cases = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(_REPLIES)], "i int, kind string, reply string")
    rows = read(spark, d, "conversations").join(F.broadcast(cases), (F.col("conv_id") * 7 + F.col("turn")) % len(_REPLIES) == F.col("i"))  # the cases above
    r = F.col("reply")
    return rows.select("conv_id", "turn", "kind", F.when(F.col("kind") == "mcq", answers.choice(r)).when(F.col("kind") == "tf", answers.truth(r)).otherwise(answers.verdict(r)).alias("answer"))


@query(r"""
SELECT p_partkey, 'A. ' || p_name || '|B. ' || p_brand || '|C. ' || p_type AS options FROM part
""")
def txt_question_options(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("Ai? A. "), "p_name", F.lit("  B) "), "p_brand", F.lit(" C. "), "p_type", F.lit(" "))
    return read(spark, d, "part").select("p_partkey", F.array_join(answers.options(q), "|").alias("options"))


@query(r"""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def txt_reply_json(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id") % 3
    reply = F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(i == 1, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.concat(F.lit("So: "), "props", F.lit(" done.")))
    return read(spark, d, "events").select("event_id", answers.parsed(reply, "k bigint")["k"].alias("k"))


@query(r"""
SELECT signature, relations, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Politician->SERVED_AS->Position' WHEN o_orderkey % 3 = 1 THEN 'Politician->SUCCEEDED_INV->Politician->BORN_AT->Location' ELSE 'Politician->BORN_YEAR->Year' END AS signature,
         CASE WHEN o_orderkey % 3 = 0 THEN 'SERVED_AS' WHEN o_orderkey % 3 = 1 THEN 'SUCCEEDED,BORN_AT' ELSE 'BORN_YEAR' END AS relations FROM orders) GROUP BY ALL
""")
def txt_path_signatures(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    raw = F.when(i == 0, F.concat(F.lit('["pol'), k, F.lit('","SERVED_AS","pos'), k, F.lit('_001"]'))).when(i == 1, F.concat(F.lit("pol"), k, F.lit(" -> SUCCEEDED_INV -> pol1 -> BORN_AT -> loc2_001"))).otherwise(F.concat(F.lit("pol"), k, F.lit("|BORN_YEAR|YEAR_1950")))
    path = text.path_array(raw)
    return read(spark, d, "orders").groupBy(text.path_signature(path).alias("signature"), F.array_join(text.path_relations(path), ",").alias("relations")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 4 THEN strftime(o_orderdate, '%Y') ELSE 'nay' END AS normalized,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL WHEN o_orderkey % 6 = 4 THEN strftime(o_orderdate, '%Y') || '-01-01' WHEN o_orderkey % 6 = 1 THEN strftime(o_orderdate, '%Y') || '-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE year(o_orderdate) END AS y FROM orders
""")
def dat_texts(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = (
        F.when(i == 0, F.date_format(t, "'ngày' d 'tháng' M 'năm' yyyy")).when(i == 1, F.date_format(t, "'tháng' M, yyyy")).when(i == 2, F.date_format(t, "yyyy-MM-dd"))
        .when(i == 3, F.date_format(t, "d/M/yyyy")).when(i == 4, F.date_format(t, "yyyy")).otherwise("nay")
    )
    templated = F.when(i == 0, F.date_format(t, "'{{ngày sinh và tuổi|'yyyy'|'M'|'d'}}'")).when(i == 2, F.date_format(t, "'{{birth date|df=yes|'yyyy'|'M'|'d'}}'")).otherwise(raw)
    texts = read(spark, d, "orders").select("o_orderkey", raw.alias("raw"), templated.alias("templated"))
    x = F.col("raw")
    return texts.select("o_orderkey", dates.normalized(x).alias("normalized"), dates.valid(dates.from_template(F.col("templated"), 2025)).alias("parsed"), dates.birth_year(x).alias("y"))


@query(r"""
SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '2024-02-29' END AS valid_date, 'từ ' || (1990 + n_nationkey) || ' đến nay' AS duration FROM nation
""")
def dat_validity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    day = F.struct(F.when(k % 2 == 0, 2024).otherwise(2023).alias("y"), F.lit(2).alias("m"), F.lit(29).alias("d"))
    return read(spark, d, "nation").select("n_nationkey", dates.valid(day).alias("valid_date"), dates.duration_label((1990 + k).cast("string"), F.lit("nay")).alias("duration"))


@query(r"""
SELECT l_orderkey, list_reduce(list(x ORDER BY i), lambda acc, y: CASE WHEN contains(acc, y) THEN acc ELSE acc || '; ' || y END) AS merged
FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus) AS i FROM lineitem) GROUP BY l_orderkey
""")
def prj_merge_values(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat("l_returnflag", "l_linestatus")
    each = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", x.alias("x"))))
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(each.alias("e")).select("l_orderkey", merged_text(F.transform("e", lambda v: v["x"])).alias("merged"))


@query(r"""
SELECT c_custkey, 'name=' || c_name || ';office=' || c_mktsegment || ';term_start=2010-03' AS fields FROM customer
""")
def prj_clean_records(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    raw = F.create_map(F.lit("tên"), F.concat(F.lit("[[x|"), "c_name", F.lit("]]")), F.lit("chức vụ"), F.concat("c_mktsegment", F.lit("|term_start=tháng 3, 2010|junk")), F.lit("hình"), F.lit("[[File:a.png]]"))
    rows = c.select("c_custkey", F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("id"), F.lit("infobox").alias("template"), raw.alias("infobox"))
    done = records.cleaned(records.normalized_keys(rows))
    fields = F.array_join(F.transform(F.array_sort(F.map_entries("infobox")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return done.select("c_custkey", fields.alias("fields"))


@query(r"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '1950-01-02' WHEN s_suppkey % 3 = 1 THEN '1950' END AS birth_date FROM supplier
""")
def prj_overlay_dates(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("title"), F.col("s_suppkey").cast("string").alias("id"))
    i = F.col("s_suppkey") % 3
    empty = F.expr("cast(map() as map<string,string>)")
    old = s.withColumn("infobox", F.when(i == 1, F.create_map(F.lit("birth_date"), F.lit("1950"))).otherwise(empty))
    raw = s.withColumn("infobox", F.when(i == 0, F.create_map(F.lit("birth_date"), F.lit("{{ngày sinh và tuổi|1950|1|2}}"))).when(i == 1, F.create_map(F.lit("birth_date"), F.lit("30/2/1950"))).otherwise(empty)).select("title", "id", "infobox")
    return records.overlay_dates(old, raw, 2025).select("s_suppkey", F.col("infobox")["birth_date"].alias("birth_date"))


@query(r"""
SELECT event_type, count(*) FILTER (WHERE user_id % 3 <> 2) AS entities, count(*) FILTER (WHERE user_id % 2 = 0) AS relations FROM events GROUP BY event_type
""")
def prj_allowed_entities(spark: SparkSession, d: str) -> DataFrame:
    e, u = read(spark, d, "events"), F.col("user_id")
    kind = F.when(u % 3 == 0, "Politician").when(u % 3 == 1, "Award").otherwise("Robot")
    reply = F.struct(F.array(F.struct(F.lit("x").alias("text"), kind.alias("type"))).alias("entities"), F.array(F.when(u % 2 == 0, "BORN_AT").otherwise("LIKES")).alias("intent_relation"))
    rows = e.select(F.col("event_id").alias("id"), "event_type", F.lit("?").alias("question"), reply.alias("answer_json"))
    kept = records.extraction_filter(rows)
    return kept.groupBy("event_type").agg(F.sum(F.size("answer_json.entities")).alias("entities"), F.sum(F.size("answer_json.intent_relation")).alias("relations"))


@query(r"""
SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3
""")
def ord_recent_turns(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.workflow import recent_turns

    return recent_turns(read(spark, d, "conversations"), 3).select("conv_id", "turn")


_KEYS = [(p, w) for p, ws in C.PATTERN_KEYWORDS.items() for w in ws]
_QUESTIONS = ["Ai là người kế nhiệm A?", "A và B có mối quan hệ gì?", "So sánh A hay B, ai nhiều hơn", "Có bao nhiêu người", "A sinh ở đâu, đúng không?", "Chọn: A. x B. y"]


def _score_sql(source: str, keys: str) -> str:
    """The pattern of each row of source (keys, question, q in lower case, n, intent)."""
    hit = lambda p: " OR ".join(f"regexp_matches(q, '{w}')" for w in C.PATTERN_KEYWORDS[p])
    has = lambda *ws: "(" + " OR ".join(f"contains(q, '{w}')" for w in ws) + ")"
    return f"""
WITH {source},
s AS (SELECT *, CASE WHEN {hit('path')} THEN 0.3 ELSE 0 END + CASE WHEN n = 2 THEN 0.1 ELSE 0 END + CASE WHEN {has('giữa', 'mối quan hệ', 'liên kết')} THEN 0.14 ELSE 0 END AS s_path,
  CASE WHEN {hit('chain')} THEN 0.3 ELSE 0 END + CASE WHEN intent IN ('SUCCEEDED', 'PRECEDED') THEN 0.3 ELSE 0 END AS s_chain,
  CASE WHEN {hit('comparison')} THEN 0.3 ELSE 0 END + CASE WHEN n = 2 THEN 0.1 ELSE 0 END + CASE WHEN {has(' hay ', ' hoặc ')} THEN 0.12 ELSE 0 END AS s_cmp,
  CASE WHEN {hit('aggregation')} THEN 0.3 ELSE 0 END AS s_agg, CASE WHEN n = 1 THEN 0.2 ELSE 0 END + CASE WHEN intent IN ('BORN_AT', 'DIED_AT', 'SERVED_AS', 'ALUMNUS_OF', 'AWARDED') THEN 0.3 ELSE 0 END AS s_simple,
  CASE WHEN n >= 3 THEN 0.2 ELSE 0 END + CASE WHEN {has(' và ', ', ')} THEN 0.12 ELSE 0 END + CASE WHEN {has('đúng hay sai', 'đúng không', 'có phải', 'có đúng')} THEN 0.16 ELSE 0 END + CASE WHEN regexp_matches(question, '[A-D][.)]\\s+') THEN 0.16 ELSE 0 END AS s_exp FROM x),
t AS (SELECT *, CASE WHEN greatest(s_path, s_chain, s_cmp, s_agg, s_simple, s_exp) < 0.3 THEN s_exp + 0.5 ELSE s_exp END AS e2 FROM s),
b AS (SELECT *, greatest(s_path, s_chain, s_cmp, s_agg, s_simple, e2) AS top FROM t)
SELECT {keys}, CASE top WHEN s_simple THEN 'simple' WHEN s_chain THEN 'chain' WHEN s_path THEN 'path' WHEN s_cmp THEN 'comparison' WHEN s_agg THEN 'aggregation' ELSE 'explore' END AS pattern, round(CAST(top AS DOUBLE), 6) AS score FROM b
"""


_FIXED_QUESTIONS = f"""v(i, question) AS (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(_QUESTIONS))}),
x AS (SELECT c.conv_id, c.turn, v.question, lower(v.question) AS q, c.turn % 4 AS n, CASE c.conv_id % 3 WHEN 0 THEN 'SUCCEEDED' WHEN 1 THEN 'BORN_AT' END AS intent FROM conversations c JOIN v ON (c.conv_id + c.turn) % {len(_QUESTIONS)} = v.i)"""


@query(_score_sql(_FIXED_QUESTIONS, "conv_id, turn"))
def wf_pattern(spark: SparkSession, d: str) -> DataFrame:
    from tessera.operators.workflow import best_pattern, pattern_scores

    qs = spark.createDataFrame(list(enumerate(_QUESTIONS)), "i int, question string")
    rows = read(spark, d, "conversations").join(F.broadcast(qs), (F.col("conv_id") + F.col("turn")) % len(_QUESTIONS) == F.col("i"))  # the questions above
    intent = F.when(F.col("conv_id") % 3 == 0, "SUCCEEDED").when(F.col("conv_id") % 3 == 1, "BORN_AT")
    s = pattern_scores(F.col("question"), F.col("turn") % 4, intent)
    best = best_pattern(s)
    return rows.select("conv_id", "turn", best["pattern"].alias("pattern"), F.round(best["score"], 6).alias("score"))


_EDGE_QUESTIONS = f"""{N}, {E},
p(kind, said, ask, intent) AS (VALUES ('LOCATED_IN', 'sinh tại', 'sinh ở đâu', 'BORN_AT'), ('PLACED', 'đã từng giữ chức vụ', 'giữ chức vụ gì', 'SERVED_AS'), ('SUCCEEDED', 'kế nhiệm', 'kế nhiệm ai', 'SUCCEEDED')),
w AS (SELECT e.edge_id, a.name AS a, b.name AS b, p.* FROM e JOIN p ON p.kind = e.type JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst),
y AS (SELECT edge_id, 'truth' AS form, a || ' ' || said || ' ' || b || '. Đúng hay sai?' AS question, 2 AS n, intent FROM w UNION ALL SELECT edge_id, 'choice', a || ' ' || ask || '?', 1, intent FROM w),
x AS (SELECT *, lower(question) AS q FROM y)"""


@query(_score_sql(_EDGE_QUESTIONS, "edge_id, form"))
def wf_edge_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The pattern of a true-false and a choice question about each edge of three relations."""
    from tessera.operators.graph import named
    from tessera.operators.questions import multi_hop_text
    from tessera.operators.workflow import best_pattern, pattern_scores

    relation = F.create_map(*[F.lit(x) for x in ("LOCATED_IN", "BORN_AT", "PLACED", "SERVED_AS", "SUCCEEDED", "SUCCEEDED")])[F.col("type")]
    e = named(graph(spark, d, ("LOCATED_IN", "PLACED", "SUCCEEDED"))).select("edge_id", F.array("src_name", "dst_name").alias("names"), F.array(relation).alias("types"))
    form = lambda f, choice, n: F.struct(F.lit(f).alias("form"), multi_hop_text(F.col("names"), F.col("types"), choice).alias("question"), F.lit(n).alias("n"))
    q = e.select("edge_id", F.col("types")[0].alias("intent"), F.inline(F.array(form("truth", False, 2), form("choice", True, 1))))
    best = best_pattern(pattern_scores(F.col("question"), F.col("n"), F.col("intent")))
    return q.select("edge_id", "form", best["pattern"].alias("pattern"), F.round(best["score"], 6).alias("score"))


@query("""
SELECT p_partkey, p_name || ' ' || p_brand || ' hạng I|' || p_name || ' ' || p_brand || ' hạng II|' || p_type AS awards, (1930 + p_size) || '-' || CASE WHEN p_partkey % 3 > 0 THEN '' || CAST(1930 + p_size + p_partkey % 9 AS INTEGER) ELSE '' END AS years,
  CASE p_partkey % 4 WHEN 0 THEN 'bị cách chức' WHEN 1 THEN 'miễn nhiệm' WHEN 2 THEN 'bị cách chức' ELSE '' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'Đảng Cộng sản Việt Nam|Đảng ' || p_type ELSE 'Đảng ' || p_type END AS parties
FROM part
""")
def txt_record_values(spark: SparkSession, d: str) -> DataFrame:
    """Awards, years of service, ends of offices and parties that are said with each part's own names and numbers."""
    k, size = F.col("p_partkey"), F.col("p_size")
    award = F.concat(F.lit(". "), "p_name", F.lit(" "), "p_brand", F.lit(" hạng I, II, "), "p_type", F.lit(" (3), "), "p_type")
    years = F.concat(F.lit("quân đội "), (1930 + size).cast("string"), F.when(k % 2 == 0, " – ").otherwise(" - "), F.when(k % 3 == 0, "nay").otherwise((1930 + size + k % 9).cast("string")))
    office = F.concat("p_name", F.when(k % 4 == 0, ", bị cách chức năm ").when(k % 4 == 1, " từ chức năm ").when(k % 4 == 2, ", bị cách chức và miễn nhiệm ").otherwise(" từ "), (1930 + size).cast("string"))
    party = F.concat(F.when(k % 2 == 0, "ĐCSVN; ").otherwise(""), F.lit("Đảng "), "p_type", F.lit(", Đảng  "), "p_type")
    y = text.service_years(years)
    return read(spark, d, "part").select("p_partkey", F.array_join(text.split_awards(award), "|").alias("awards"), F.concat(y["year_start"].cast("string"), F.lit("-"), F.coalesce(y["year_end"].cast("string"), F.lit(""))).alias("years"), text.office_status(office).alias("status"), F.array_join(text.split_parties(party), "|").alias("parties"))


@query("""
SELECT o_orderkey, substr('ABCD', CAST(o_custkey % 4 + 1 AS INTEGER), 1) AS letter, CASE WHEN o_custkey % 5 = 0 THEN 'Không có dữ kiện' WHEN o_totalprice > 250000 THEN 'Đúng' ELSE 'Sai' END AS truth FROM orders
""")
def txt_order_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies that settle on a letter and on a truth that come from each order, in the forms that models use."""
    o, form = read(spark, d, "orders"), F.substring("o_orderpriority", 1, 1).cast("int")
    letter = F.substring(F.lit("ABCD"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1))
    low = F.lower(letter)
    name = F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string"))
    reply = F.when(form == 1, F.concat(letter, F.lit(". "), name)).when(form == 2, F.concat(F.lit("Theo "), name, F.lit(" là ["), low, F.lit("]"))).when(form == 3, F.concat(name, F.lit("\nĐáp án: "), low)).when(form == 4, F.concat(F.lit("Vì "), name, F.lit(" nên chọn "), letter)).otherwise(low)
    said = F.when(F.col("o_custkey") % 5 == 0, "Không có dữ kiện").when(F.col("o_totalprice") > 250000, "Đúng").otherwise("Sai")
    truth = F.when(form == 1, said).when(form == 2, F.concat(name, F.lit("\nKết luận: "), F.lower(said))).when(form == 3, F.concat(F.lit("Câu trả lời là "), F.lower(said), F.lit(", theo "), name)).otherwise(F.concat(F.lit("Với "), name, F.lit(" thì "), F.lower(said)))
    return o.select("o_orderkey", answers.choice(reply).alias("letter"), answers.truth(truth).alias("truth"))


@query("""
WITH x AS (SELECT year(o_orderdate) AS y, 1 + o_custkey % 13 AS m, 1 + o_orderkey % 31 AS d, o_orderkey % 4 AS form FROM orders),
k AS (SELECT form, try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AS ok FROM x)
SELECT 'birth_date' AS "column", count(*) FILTER (WHERE form < 3 AND ok) AS normalized, count(*) FILTER (WHERE form < 3 AND NOT ok) AS failed, count(*) FILTER (WHERE form = 3) AS absent FROM k
UNION ALL SELECT 'death_date', count(*) FILTER (WHERE form = 1 AND ok), count(*) FILTER (WHERE form = 1 AND NOT ok), count(*) FILTER (WHERE form <> 1) FROM k
""")
def dat_day_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days in templates and texts, a part of which don't exist."""
    from tessera.operators.records import day_counts

    form = F.col("o_orderkey") % 4
    y, m, day = F.year("o_orderdate").cast("string"), (1 + F.col("o_custkey") % 13).cast("string"), (1 + F.col("o_orderkey") % 31).cast("string")
    birth = F.when(form == 0, F.concat(F.lit("{{ngày sinh và tuổi|"), F.concat_ws("|", y, m, day), F.lit("}}"))).when(form == 1, F.concat_ws("/", day, m, y)).when(form == 2, F.concat(F.lit("{{birth date|df=yes|"), F.concat_ws("|", y, m, day), F.lit("}}"))).otherwise("không rõ")
    death = F.when(form == 0, None).when(form == 1, F.concat(F.lit("{{ngày mất|"), F.concat_ws("|", y, m, day), F.lit("}}"))).otherwise("")
    return day_counts(read(spark, d, "orders").select(birth.alias("birth_date"), death.alias("death_date")), ["birth_date", "death_date"], 2024)
