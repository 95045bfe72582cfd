"""Graph algorithms in plain Python, one node at a time, for small graphs."""

from __future__ import annotations

import random
from collections import defaultdict, deque


def distances(near: dict, start) -> dict:
    found, front = {start: 0}, [start]
    for v in front:
        for w in near.get(v, ()):
            if w not in found:
                found[w] = found[v] + 1
                front.append(w)
    return found


def neighbours(edges) -> dict:
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
    return near


def betweenness(ids, edges) -> dict:
    near, out = neighbours(edges), dict.fromkeys(ids, 0.0)
    for s in ids:
        count, dist, order, before = defaultdict(float, {s: 1.0}), {s: 0}, [], defaultdict(list)
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        add = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                add[v] += count[v] / count[w] * (1 + add[w])
            if w != s:
                out[w] += add[w]
    n = len(ids)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else x for v, x in out.items()}


def strong_components(ids, edges) -> dict:
    near, back = neighbours(edges), neighbours((b, a) for a, b in edges)
    out = {}
    for v in sorted(ids):
        if v not in out:
            for w in set(distances(near, v)) & set(distances(back, v)):
                out.setdefault(w, v)
    return out


def modularity(links, place, resolution=1.0) -> float:
    """links: (a, b, weight), each pair once."""
    inner, ends = defaultdict(float), defaultdict(float)
    m = sum(w for _, _, w in links)
    for a, b, w in links:
        inner[place[a]] += w * (place[a] == place[b])
        ends[place[a]] += w
        ends[place[b]] += w
    return sum(inner[c] / m - resolution * (ends[c] / (2 * m)) ** 2 for c in ends)


def louvain(ids, links, resolution=1.0, seed=42) -> dict:
    """One node after another, in random order."""
    rng = random.Random(seed)
    near = {i: defaultdict(float) for i in ids}
    for a, b, w in links:
        near[a][b] += w
        near[b][a] += w
    own, place = dict.fromkeys(ids, 0.0), {i: i for i in ids}
    while True:
        strength = {i: sum(near[i].values()) + 2 * own[i] for i in near}
        m2 = sum(strength.values())
        of, total, moved = {i: i for i in near}, dict(strength), True
        while moved:
            moved = False
            for i in rng.sample(sorted(near), len(near)):
                to = defaultdict(float)
                for j, w in near[i].items():
                    to[of[j]] += w
                total[of[i]] -= strength[i]
                best = max(sorted({*to, of[i]}), key=lambda c: (round(to[c] - resolution * total[c] * strength[i] / m2, 9), c == of[i]))
                total[best] += strength[i]
                moved |= best != of[i]
                of[i] = best
        place = {i: of[c] for i, c in place.items()}
        if len(set(of.values())) == len(near):
            return place
        up, inner = {c: defaultdict(float) for c in of.values()}, defaultdict(float)
        for i, x in near.items():
            inner[of[i]] += own[i]
            for j, w in x.items():
                if of[j] == of[i]:
                    inner[of[i]] += w / 2
                else:
                    up[of[i]][of[j]] += w
        near, own = up, inner


def merged(place, pairs, smallest) -> dict:
    """The smallest community first, one at a time; those without links last."""
    place = dict(place)
    while True:
        sizes = defaultdict(int)
        for c in place.values():
            sizes[c] += 1
        small = sorted((n, c) for c, n in sizes.items() if n < smallest)
        if not small or len(sizes) == 1:
            return place
        to = defaultdict(lambda: defaultdict(int))
        for a, b in {(a, b) for a, b in pairs if a != b}:
            if place[a] != place[b]:
                to[place[a]][place[b]] += 1
                to[place[b]][place[a]] += 1
        linked = [c for _, c in small if to[c]]
        if linked:
            c = linked[0]
            into = min(to[c], key=lambda x: (-to[c][x], x))
        else:
            into = min(sizes, key=lambda x: (-sizes[x], x))
            c = next(c for _, c in small if c != into) if any(c != into for _, c in small) else None
        if c is None:
            return place
        place = {i: into if x == c else x for i, x in place.items()}
