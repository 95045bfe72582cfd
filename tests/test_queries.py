"""Every registered query of the library against its SQL."""

from collections import Counter, defaultdict

import pytest

from tessera.functions.answers import similarity_match
from tests import brute_graphs
from tests.conftest import DATA, rows_of
from tessera.plans import build_queries, graph_queries, io_queries, profile_queries, question_queries, tables, text_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(tables.SQL))
def test_against_sql(spark, duck, name):
    frame = tables.QUERIES[name](spark, DATA)
    found = duck.execute(tables.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert rows_of(sorted(columns), [r.asDict() for r in frame.collect()]) == rows_of(sorted(columns), expected)


def graph_of(duck, sql):
    """Out-neighbours by node."""
    near = defaultdict(set)
    for a, b in duck.execute(sql).fetchall():
        near[a].add(b)
    return near


def distances(near, start):
    found, front = {start: 0}, [start]
    for v in front:
        for w in near.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                front.append(w)
    return found


def edges_sql(where="true"):
    return f"WITH {tables.E} SELECT src, dst FROM e WHERE {where}"


def trade_sql():
    return f"WITH {graph_queries._PAIRS} SELECT a, b FROM u UNION SELECT b, a FROM u"


def check_ga_sample(rows, duck):
    assert len({r.id for r in rows}) == 10 and {r.type for r in rows} == {"Customer"}


def check_alg_betweenness(rows, duck):
    nodes = [i for (i,) in duck.execute(f"WITH {tables.N} SELECT id FROM n").fetchall()]
    expected = brute_graphs.betweenness(nodes, duck.execute(edges_sql()).fetchall())
    assert {r.id: r.betweenness for r in rows} == pytest.approx(expected)


def check_alg_reach_sketched(rows, duck):
    """Numbers and sums of distances within 3 standard errors of the sketches, and none where nothing leads."""
    near, total, count = graph_of(duck, edges_sql()), Counter(), Counter()
    for s in list(near):
        for v, d in distances(near, s).items():
            total[v] += d
            count[v] += d > 0
    assert len(rows) == duck.execute(f"WITH {tables.N} SELECT count(*) FROM n").fetchone()[0]
    for r in rows:
        assert r.sources == pytest.approx(count[r.id], rel=3 * 1.04 / 64) and r.total == pytest.approx(total[r.id], rel=3 * 1.04 / 64)


def check_vec_index(rows, duck):
    v = {i: [x / sum(y * y for y in e) ** 0.5 for x in e] for i, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    exact = {(q, i) for q in v if q % 100 == 0 for i in sorted(v, key=lambda j: (-round(sum(a * b for a, b in zip(v[q], v[j], strict=True)), 12), j))[:10]}
    assert len(rows) == len(exact) and len(exact & {(r.query_id, r.id) for r in rows}) >= 0.9 * len(exact)


def check_jon_similar_names(rows, duck):
    left = [x for (x,) in duck.execute("SELECT DISTINCT p_name || ' of the kind ' || lower(p_type) FROM part").fetchall()]
    right = [x for (x,) in duck.execute("SELECT DISTINCT replace(p_name, 'e', 'ee') || ' of a kind ' || p_type FROM part").fetchall()]
    expected = {(a, b) for a in left for b in right if similarity_match(a, b, 0.9)}
    assert {(r.left, r.right) for r in rows} == expected and len(rows) == len(expected) > 50


def check_alg_closeness(rows, duck):
    near = graph_of(duck, trade_sql())
    part = max((set(distances(near, s)) for s in near), key=len)
    expected = {}
    for s in part:
        d = [x for x in distances(near, s).values() if x]
        expected[s] = len(d) / sum(d) * len(d) / (len(part) - 1)
    assert {r.id: r.closeness for r in rows} == pytest.approx(expected)


def check_alg_path_lengths(rows, duck):
    near = graph_of(duck, trade_sql())
    part = max((set(distances(near, s)) for s in near), key=len)
    d = [x for s in part for x in distances(near, s).values() if x]
    (r,) = rows
    assert (r.nodes, r.shortest, r.longest) == (len(part), min(d), max(d)) and r.mean_length == pytest.approx(sum(d) / len(d))


def check_alg_small_world(rows, duck):
    """Places are more clustered than graphs of their degrees, all in one component or several; the 95 % ranges hold the means."""
    (r,) = rows
    assert r.c_ratio > 1 and r.sigma > 0 and r.p_clustering < 0.05 and 0 <= r.p_length <= 1 and r.small_world == (r.sigma > 1)
    assert all(r[f"range_{k}"][0] <= r[f"mean_{k}"] <= r[f"range_{k}"][1] for k in ("clustering", "mean_length"))


def check_alg_eigenvector(rows, duck):
    """Of each community A x = c x, where it has settled."""
    x = {r.id: r.eigenvector for r in rows}
    of = {r.id: r.community for r in rows}
    links = duck.execute(f"WITH {graph_queries._TRADE} SELECT w.a, w.b, weight, p.community FROM w JOIN c p ON p.id = w.a JOIN c q ON q.id = w.b WHERE p.community = q.community").fetchall()
    assert set(x) == {y for a, b, _, _ in links for y in (a, b)} and all(of[a] == of[b] == c for a, b, _, c in links)
    image = defaultdict(float)
    for a, b, w, _ in links:
        image[a] += w * x[b]
        image[b] += w * x[a]
    for c in set(of.values()):
        ids = [i for i in x if of[i] == c]
        norm = sum(image[i] ** 2 for i in ids) ** 0.5
        assert max(abs(image[i] / norm - x[i]) for i in ids) < 0.02 or sum(x[i] ** 2 for i in ids) != pytest.approx(1)


def check_alg_louvain(rows, duck):
    """A partition in groups of ten and more, better than one group and than the nations."""
    of = {r.id: r.community for r in rows}
    sizes = Counter(of.values())
    assert len(of) == duck.execute("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)").fetchone()[0] and min(sizes.values()) >= 10
    links = duck.execute(f"WITH {graph_queries._TRADE} SELECT a, b, weight FROM w").fetchall()
    nation = dict(duck.execute(f"WITH {graph_queries._TRADE} SELECT id, community FROM c").fetchall())

    def modularity(part):
        m, inner, ends = sum(w for _, _, w in links), Counter(), Counter()
        for a, b, w in links:
            inner[part[a]] += w * (part[a] == part[b])
            ends[part[a]] += w
            ends[part[b]] += w
        return sum(inner[c] / m - 1.5 * (ends[c] / (2 * m)) ** 2 for c in ends)

    assert modularity(of) > max(modularity(nation), modularity(dict.fromkeys(of, 0)))
    usual = [brute_graphs.merged(brute_graphs.louvain(sorted(of), links, 1.5, s), [x[:2] for x in links], 10) for s in range(5)]
    assert modularity(of) >= 0.98 * sum(map(modularity, usual)) / 5


def check_gen_shortest_candidates(rows, duck):
    """Each path is one of edges that are there, has no shorter one, and 2 to 4 edges; most customers have some."""
    typed = set(duck.execute(f"WITH {tables.E} SELECT src, type, dst FROM e WHERE type <> 'PRECEDED'").fetchall())
    near = defaultdict(set)
    for a, _, b in typed:
        near[a].add(b)
    assert len(rows) > 100 and len({r.path for r in rows}) == len(rows)
    for r in rows:
        p = r.path.split("|")
        assert all((p[i], p[i + 1], p[i + 2]) in typed for i in range(0, len(p) - 2, 2))
        assert 2 <= r.hop_count <= 4 and distances(near, p[0])[p[-1]] == r.hop_count == len(p) // 2


@pytest.mark.parametrize("name", sorted(set(tables.QUERIES) - set(tables.SQL)))
def test_without_sql(spark, duck, name):
    globals()[f"check_{name}"](tables.QUERIES[name](spark, DATA).collect(), duck)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["name", "position", "term_start", "status"]
    assert set(e.oracle_sql()) <= set(e.queries())
