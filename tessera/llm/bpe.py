"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one BPE encoding, and so one valid last token. `PrefixEncoder` stores that
token for each prefix length: appending bytes only adds entries, and an edit keeps all entries before it.
A token t may follow the last token s of the prefix before it iff BPE leaves s and t apart, which their
derivations decide (`Vocabulary.apart`).

Cases: null text is the empty text and has no ids; repeated rows give repeated results; texts are encoded whole, however long;
columns other than doc_id and text are not looked at, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm._common import arrow_stage, table, worker_state

#: Unicode White_Space, which the tokenizer's pattern means by \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text is cut here first; a cut never falls within a match of the public tokenizers' pattern. For other patterns it isn't cut.
CHUNK = re.compile(f"[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]+")
#: Entries a worker keeps of chunks, in two generations: the older goes when the younger is full. Of prefixes and token pairs half as many, of pieces a quarter.
CACHE = 250_000
#: Bytes of a piece up to which its prefixes are kept for other pieces.
SHORT = 96


class Kept(dict):
    """make(key) by key. Beyond `most` entries these become the old generation; what is used of it comes back."""

    def __init__(self, make: Callable, most: int):
        self.make, self.old, self.most = make, {}, most

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Vocabulary:
    """Ranks by bytes, from the lines of a .tiktoken file."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines() if lines else [])}
        self.bytes = {v: k for k, v in self.rank.items()}
        self.longest = max(map(len, self.rank), default=1)
        self._split: dict[int, tuple[int, int] | None] = {}
        self.pairs = Kept(lambda pair: self._apart(*pair), CACHE // 2)
        self.last = Kept(self._last, CACHE // 2)

    def merged(self, piece: bytes) -> list[int]:
        """BPE as defined: the adjacent pair of lowest rank merges first, the leftmost of equals. Used for single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranks:
                break
            _, i = min(ranks)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[x] for x in parts]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for a byte; None if merging never makes it."""
        if token not in self._split:
            own, found = self.bytes[token], None
            if len(own) == 1:
                found = (token, token)
            elif self.merged(own) == [token]:
                del self.rank[own]
                two = self.merged(own)
                self.rank[own] = token
                if len(two) == 2:
                    found = (two[0], two[1])
            self._split[token] = found
        return self._split[token]

    def spine(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one end of this one while it is built, the last one first."""
        out = [token]
        while len(self.bytes[out[-1]]) > 1:
            two = self.split(out[-1])
            if two is None:
                break
            out.append(two[side])
        return out

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives just these two."""
        return self.pairs[left, right]

    def _apart(self, left: int, right: int) -> bool:
        never = 1 << 60
        a, b = self.spine(left, 1), self.spine(right, 0)
        i, j = len(a) - 1, len(b) - 1  # from single bytes up to the whole tokens
        while True:
            until_a, until_b = (a[i - 1] if i else never), (b[j - 1] if j else never)
            across = self.rank.get(self.bytes[a[i]] + self.bytes[b[j]], never)
            if across < until_a and across <= until_b and across < never:
                return False
            if until_a == until_b == never:
                return True
            if until_a <= until_b:
                i -= 1
            else:
                j -= 1


    def _last(self, prefix: bytes) -> int:
        """The only valid last token of the prefix, by those of the shorter prefixes that it asks for (self.last keeps them)."""
        rank = self.rank
        for start in range(len(prefix)):
            token = rank.get(prefix[start:])
            if token is not None and self.split(token) is not None and (not start or self.pairs[self.last[prefix[:start]], token]):
                return token
        raise ValueError("a byte has no token")

    def short(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a short piece, from the last tokens of prefixes that other pieces share."""
        out = []
        while piece:
            out.append(token := self.last[piece])
            piece = piece[: -len(self.bytes[token])]
        return tuple(out[::-1])


class PrefixEncoder:
    """The encoding of a growing piece: last[i] is the last token of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> PrefixEncoder:
        v, at = self.vocabulary, len(self.data)
        self.data = data = self.data + more
        last, rank, longest = self.last, v.rank, v.longest
        for end in range(at + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = rank.get(data[start:end])
                if token is not None and v.split(token) is not None and (not start or v.apart(last[start], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
        return self

    def edit(self, at: int, until: int, new: bytes) -> PrefixEncoder:
        """Bytes at..until become `new`; prefixes up to `at` keep their tokens."""
        rest = self.data[until:]
        self.data = self.data[:at]
        del self.last[at + 1 :]
        return self.append(new + rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes[self.last[at]])
        return out[::-1]


class Codec:
    """Texts to ids and back, each match of the pattern for itself, as the tiktoken library does without special tokens."""

    def __init__(self, lines: bytes, pattern: str):
        self.vocabulary = Vocabulary(lines)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))
        self.cut = pattern == public_tokenizers.PATTERN
        self.pieces = Kept(self._piece, CACHE // 4)
        self.chunks = Kept(self._chunk, CACHE)

    def _piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.vocabulary.rank.get(piece)  # a piece that is a token stays whole, even if merges don't make it
        if whole is not None:
            return (whole,)
        return self.vocabulary.short(piece) if len(piece) <= SHORT else tuple(PrefixEncoder(self.vocabulary, piece).ids())

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable([self.pieces[x.encode()] for x in self.pattern.findall(chunk)]))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.chunks.__getitem__, CHUNK.findall(text or "")))) if self.cut else list(self._chunk(text or ""))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = worker_state("bpe")


def codec_of(lines: bytes, pattern: str) -> Codec:
    """The worker's codec for a vocabulary, kept between tasks."""
    key = (hashlib.sha256(lines).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(lines, pattern)
    return _CODECS[key]


def vocabulary_lines(path: str) -> bytes:
    """A vocabulary file (under 1 MB), read on the driver; a broadcast carries it to the executors."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids: the token ids of every whole text."""
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary_lines(path))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(lines.value, pattern)
        for b in batches:
            yield table({"doc_id": b.column(0), "ids": [codec.encode(x.as_py()) for x in b.column(1)]}, schema)

    return arrow_stage(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, ids array<int>", ("bpe",))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data: the bytes that each row's ids stand for (null: none)."""
    lines = encoded.sparkSession.sparkContext.broadcast(vocabulary_lines(path))
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(lines.value, pattern)
        for b in batches:
            yield table({"doc_id": b.column(0), "data": [codec.decode(x.as_py() or ()) for x in b.column(1)]}, schema)

    return arrow_stage(encoded.select("doc_id", "ids"), run, "doc_id bigint, data binary", ("bpe",))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over the texts, with digests of both."""
    lines = docs.sparkSession.sparkContext.broadcast(vocabulary_lines(path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(lines.value, pattern)
        digits = {i: str(i) for i in codec.vocabulary.bytes}
        for b in batches:
            n, ids_sha, decoded_sha = [], [], []
            for x in b.column(1):
                ids = codec.encode(x.as_py())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield table({"doc_id": b.column(0), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}, schema)

    return arrow_stage(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", ("bpe",))
