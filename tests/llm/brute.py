"""The operators' contracts in plain Python, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(m: str) -> bool:
    d = [int(c) for c in m if c.isdigit()][::-1]
    return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def personal(text: str | None) -> dict[str, list[tuple[int, int]]]:
    ok = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": luhn, "phone": lambda m: 8 <= sum(c.isdigit() for c in m) <= 15}
    return {k: [m.span() for m in re.finditer(r, text or "") if ok[k](m.group())] for k, r in PII.items()}


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), len(b) - len(kept), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), sha(kept)))
    return out


def lines(docs: list[tuple[int | None, str | None]], least: int = 40, least_docs: int = 5) -> list[tuple[int, int, str]]:
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(float("-inf") if i is None else i)
    hot = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for i, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if hot.get(key(x), i) == i]
        out.append((len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return out


def contamination(text: str | None, items: list[tuple[int | None, str | None]], length: int = 10) -> tuple[int, int, int, str]:
    w, hit, names = words(text), set(), set()
    at = defaultdict(list)
    for k in range(1, length + 1):
        for i in range(len(w) - k + 1):
            at[tuple(w[i : i + k])].append(i)
    for item, t in items:
        x = words(t)
        k = min(len(x), length)
        for i in range(len(x) - k + 1 if x else 0):
            for s in at.get(tuple(x[i : i + k]), ()):
                hit |= set(range(s, s + k))
                if item is not None:
                    names.add(str(item))
    return len(w), len(hit), len(names), sha(",".join(sorted(names)))


def simhash(text: str | None, size: int = 4) -> int:
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)) if x]
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps: list[int], radius: int = 4) -> list[int]:
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def shingles(text: str | None, size: int) -> set[str]:
    w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)) if x]
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(texts: list[str | None], size: int, least: float) -> list[int]:
    """The first text that links of at least that resemblance reach from each one."""
    sets, root = [shingles(t, size) for t in texts], list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]
