"""DuckDB SQL for the registered queries that SQL can express."""

from tessera.llm import codes, ledger, licenses, lm

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS kept FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
s AS (SELECT k.r, k.doc_id, k.pos, k.line, (g.key IS NOT NULL AND k.doc_id <> g.kept) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM s GROUP BY r, doc_id
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
       FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN n ON n.r = d.r
"""

_VALUES = ", ".join(f"({i}, '{label}', '{text}', {licenses.span_of(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{label}', '{phrase}')" for phrase, label in licenses.PHRASES)

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
p(label, phrase) AS (VALUES {_PHRASES}),
ph AS (SELECT label, string_split(phrase, ' ') AS ws FROM p),
pl AS (SELECT r, label, i FROM (SELECT d.r, ph.label, ph.ws, d.w, unnest(range(1, len(d.w) - len(ph.ws) + 2)) AS i FROM d, ph WHERE len(d.w) >= len(ph.ws)) WHERE w[i] = ws[1] AND w[i:i + len(ws) - 1] = ws),
b AS (SELECT r, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list(DISTINCT label) AS ls FROM pl GROUP BY r),
v(t, label, words, span) AS (VALUES {_VALUES}),
tp AS (SELECT t, label, span, list_distinct(string_split(words, ' ')) AS ws FROM v),
tw AS (SELECT t, unnest(ws) AS word FROM tp),
dw AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
oc AS (SELECT r, t, i, word FROM dw JOIN tw USING (word)),
full_enough AS (SELECT r, t FROM oc GROUP BY r, t HAVING count(DISTINCT word) >= (SELECT ceil(round({licenses.THRESHOLD} * len(ws), 9)) FROM tp WHERE tp.t = oc.t)),
x AS (SELECT a.r, a.t, a.i AS s, count(DISTINCT z.word) AS o FROM oc a JOIN full_enough USING (r, t) JOIN tp ON tp.t = a.t JOIN oc z ON z.r = a.r AND z.t = a.t AND z.i >= a.i AND z.i < a.i + tp.span GROUP BY a.r, a.t, a.i),
y AS (SELECT x.r, x.s, tp.label, tp.span, o / len(tp.ws) AS c FROM x JOIN tp ON tp.t = x.t WHERE o >= ceil(round({licenses.THRESHOLD} * len(tp.ws), 9))),
m AS (SELECT r, list(DISTINCT label) AS ls, max(c) AS c FROM y WHERE NOT EXISTS (SELECT 1 FROM y q WHERE q.r = y.r AND q.c > y.c AND abs(q.s - y.s) < y.span) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
       array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.c, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN m ON m.r = d.r
"""

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
t AS (SELECT r, unnest(w) AS a, unnest(range(len(w))) AS i FROM d),
g AS (SELECT r, i, a, lag(a) OVER (PARTITION BY r ORDER BY i) AS p FROM t),
n AS (SELECT count(*) AS n FROM t),
u AS (SELECT a, count(*) AS c FROM t GROUP BY a),
ud AS (SELECT r, a, count(*) AS c FROM t GROUP BY r, a),
b AS (SELECT p, a, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY p, a),
bd AS (SELECT r, p, a, count(*) AS c FROM g WHERE p IS NOT NULL GROUP BY r, p, a),
x AS (SELECT g.r, g.p, u.c - ud.c AS cw, n.n - len(d.w) AS rest, coalesce(b.c - bd.c, 0) AS cb, coalesce(up.c - udp.c, 0) AS cp
      FROM g JOIN d ON d.r = g.r CROSS JOIN n JOIN u ON u.a = g.a JOIN ud ON ud.r = g.r AND ud.a = g.a
      LEFT JOIN b ON b.p = g.p AND b.a = g.a LEFT JOIN bd ON bd.r = g.r AND bd.p = g.p AND bd.a = g.a
      LEFT JOIN u up ON up.a = g.p LEFT JOIN ud udp ON udp.r = g.r AND udp.a = g.p),
v AS (SELECT r, cb > 0 AS seen, CASE WHEN cb > 0 THEN cb / cp ELSE CASE WHEN p IS NULL THEN 1.0 ELSE {lm.BACKOFF} END * CASE WHEN cw > 0 THEN cw / rest ELSE 1 / (rest + 1) END END AS s FROM x),
s AS (SELECT r, avg(log10(s)) AS score, count(*) FILTER (WHERE NOT seen) AS back FROM v GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.back, 0) AS n_backed_off, round(s.score, 6) AS lm_score FROM d LEFT JOIN s ON s.r = d.r
"""

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
s AS (SELECT count(*) AS n, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * s.n) // s.l AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * s.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, s.n),
b AS (SELECT row_number() OVER () AS i, item_id, {_WORDS.format('text')} AS w FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS n FROM (SELECT i, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
x AS (SELECT q.i, q.item_id, p.r, m.doc_id, CAST(sum(q.n * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY ALL HAVING score > 0),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_CODE_ROUND = """
a{0} AS MATERIALIZED (SELECT r, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, x.v, c.e, list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v) AS d FROM x JOIN c{0} c ON c.p = x.p) GROUP BY r, p, v)"""
_CODE_MOVE = """,
c{1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{0} c LEFT JOIN (SELECT p, e, list(floor(s / n) ORDER BY j) AS v FROM (SELECT p, e, j, sum(y) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS y, unnest(range(len(v))) AS j FROM a{0}) GROUP BY p, e, j) GROUP BY p, e) n ON n.p = c.p AND n.e = c.e),"""

#: Whole numbers as doubles: exact, as all of them are far below 2^53.
OP12 = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {codes.PARTS}) + 1:(p + 1) * (len(v) // {codes.PARTS})] AS v FROM (SELECT r, v, unnest(range({codes.PARTS})) AS p FROM k)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM x WHERE r <= {codes.ENTRIES}),{"".join(_CODE_ROUND.format(i) + _CODE_MOVE.format(i, i + 1) for i in range(codes.ROUNDS))}{_CODE_ROUND.format(codes.ROUNDS)},
f AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY r),
b AS (SELECT sha256(string_agg(s, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS s FROM c{codes.ROUNDS}))
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256 FROM k JOIN f ON f.r = k.r, b
"""


def _secret_kinds() -> str:
    """A relation with the matches of each kind: r, kind, its place among kinds, start and end. A match starts after the pieces and matches before it."""
    out = []
    for i, (kind, pattern, group, least) in enumerate(ledger.RULES):
        p = pattern.replace("'", "''")
        out.append(f"""SELECT r, '{kind}' AS kind, {i} AS k, CAST(list_sum(list_transform(pieces[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(ms[j]) AS n
FROM (SELECT r, pieces, ms, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT r, string_split_regex(text, '{p}') AS pieces, regexp_extract_all(text, '{p}') AS ms FROM d)) WHERE length(regexp_extract(ms[j], '{p}', {group})) >= {least}""")
    return "\nUNION ALL ".join(out)


_SPAN_TEXT = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, k)"
_BASE = "kind IN (" + ", ".join(f"'{k}'" for k in ledger.BASE) + ")"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_secret_kinds()}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ledger.BASE)}, {_SPAN_TEXT} FILTER (WHERE {_BASE}) AS base, {_SPAN_TEXT} AS spans FROM m GROUP BY r)
SELECT d.doc_id, {", ".join(f"coalesce(g.n_{k}, 0) AS n_{k}" for k in ledger.BASE)}, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans FROM d LEFT JOIN g ON g.r = d.r
"""

SQL: dict[str, str] = {"op4_lm_scores": OP4, "op4_relational_scores": OP4, "op5_licenses": OP5, "op7_line_dedup": OP7, "op8_decontamination": OP8, "op11_ranked_search": OP11, "op12_vector_codes": OP12, "op13_secrets": OP13}
