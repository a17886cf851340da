"""Byte-level BPE by dynamic programming over prefixes.

For each byte prefix of a piece there is exactly one token that can stand last in its encoding. Prefixes keeps that token
for every prefix: a longer text only adds entries, and after an edit only the entries from the edit on are made anew. The
tokens of a text follow by walking back from its end.

A token t can follow a token a iff merging a's and t's bytes never makes a token across their border before both stand.
The tokens that touch the border meanwhile are the right spine of a and the left spine of t in their merge trees.

Defined results: null and empty texts have no ids and decode to no bytes; ids that the vocabulary lacks raise
ValueError, or give null.
The vocabulary is a file of ranks, its path a parameter. Only the named columns are read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freeing

NEVER = 1 << 62  # the rank at which a root is merged further
#: Pieces kept with their ids in a Python worker; beyond that the memo starts anew, so that memory stays bounded.
MEMO = 400_000
BATCH_BYTES = 4 << 20
START = -1
SHARED = 24  # bytes of the longest prefix whose last token is kept for other pieces


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(b): int(n) for b, n in (x.split() for x in lines if x.strip())}
        self.bytes_of = {n: b for b, n in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.trees: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.last: dict[bytes, int] = {}  # of the prefixes met so far in any piece

    def tree(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one out of its bytes alone; None for a byte or what merges can't make."""
        if token not in self.trees:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                best = min(((self.ranks.get(self.bytes_of[x] + self.bytes_of[y], NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))), default=(NEVER, 0))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            self.trees[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.trees[token]

    def made(self, token: int) -> bool:
        """Whether merges make the token out of its bytes alone."""
        return len(self.bytes_of[token]) == 1 or self.tree(token) is not None

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """Bytes of the tokens at the left (0) or right (1) border of a token, and the rank that ends each."""
        if token not in (kept := self.spines[side]):
            found, end, at = [], NEVER, token
            while True:
                found.append((self.bytes_of[at], end))
                if (halves := self.tree(at)) is None:
                    break
                end, at = at, halves[side]
            kept[token] = found
        return kept[token]

    def can_follow(self, a: int, t: int) -> bool:
        """Whether a (or no token: START) and t may stand side by side in an encoding."""
        if len(self.follows) > MEMO:
            self.follows.clear()
        self.follows[a, t] = fits = self.made(t) and (a == START or not self.crossed(a, t))
        return fits

    def crossed(self, a: int, t: int) -> bool:
        """Whether a merge across the border of a and t comes before both stand."""
        get = self.ranks.get
        for x, x_end in self.spine(a, 1):
            for y, y_end in self.spine(t, 0):
                # equal ranks are merged from the left: a's own merge comes first, t's own comes later
                if (m := get(x + y)) is not None and m < x_end and m <= y_end:
                    return True
        return False


class Prefixes:
    """The last token of each prefix of a piece's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Lengthen the piece; no earlier entry changes."""
        v, start = self.vocabulary, len(self.data)
        self.data = data = self.data + more
        get, last, longest, follows, known = v.ranks.get, self.last, v.longest, v.follows, v.last
        if len(known) > MEMO:
            known.clear()
        for end in range(start + 1, len(data) + 1):
            shared = end <= SHARED
            if shared and (t := known.get(data[:end])) is not None:
                last.append(t)
                continue
            for at in range(max(0, end - longest), end):
                t = get(data[at:end])
                if t is not None:
                    before = last[at - 1] if at else START
                    fits = follows.get((before, t))
                    if v.can_follow(before, t) if fits is None else fits:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
            if shared:
                known[data[:end]] = t

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Put new in place of data[start:end]; the entries before start stay."""
        rest = new + self.data[end:]
        self.data = self.data[:start]
        del self.last[start:]
        self.append(rest)

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes, or of all."""
        at, found = len(self.data) if end is None else end, []
        while at:
            found.append(t := self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[t])
        return found[::-1]


class Encoder(dict):
    """Ids of a text, as little-endian unsigned 32-bit integers; as a dict it keeps those of the pieces met so far."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.vocabulary, self.pieces = Vocabulary(path), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)  # a piece that is a token stays whole
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()
        if len(self) >= MEMO:
            self.clear()
        self[piece] = packed = array("I", ids).tobytes()
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, array("I", ids)))


ENCODERS: dict[tuple[str, str], Encoder] = {}  # of this Python worker, while a task runs


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in ENCODERS:
        ENCODERS[path, pattern] = Encoder(path, pattern)
    return ENCODERS[path, pattern]


def forget() -> None:
    """The encoders of this process, with all that they have met."""
    ENCODERS.clear()


def encoded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (long), n_tokens (long) and ids (binary, little-endian unsigned 32-bit) of each row's text."""
    out = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern).encode
        for k, ids in sized(((b.column(0)[i].as_py(), encode(b.column(1)[i].as_py() or "")) for b in batches for i in range(b.num_rows))):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=out)

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(freeing(each, forget), f"`{key}` long, n_tokens long, ids binary")


def decoded(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids", on_error: str = "raise") -> DataFrame:
    """key, n_tokens, ids and bytes (binary) of each row's ids. Ids that the vocabulary lacks and lengths that are no multiple of
    4 bytes raise ValueError, or give null bytes where on_error is "null"."""
    out = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = encoder(path, pattern)

        def decode(x: bytes) -> bytes | None:
            try:
                return decoder.decode(x)
            except (KeyError, IndexError, ValueError) as e:
                if on_error == "null":
                    return None
                raise ValueError(f"no token ids: {e}") from e

        for k, x in sized(((b.column(0)[i].as_py(), b.column(1)[i].as_py() or b"") for b in batches for i in range(b.num_rows))):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([len(y) // 4 for y in x], pa.int64()), pa.array(x, pa.binary()), pa.array(map(decode, x), pa.binary())], schema=out)

    return df.select(F.col(key).cast("long").alias(key), F.col(ids).alias("ids")).mapInArrow(freeing(each, forget), f"`{key}` long, n_tokens long, ids binary, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids and bytes (binary, decoded from the ids) of each row's text: encoded() and decoded() in one worker, which
    holds the vocabulary once."""
    out = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, pattern)
        for k, ids in sized(((b.column(0)[i].as_py(), known.encode(b.column(1)[i].as_py() or "")) for b in batches for i in range(b.num_rows))):
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(known.decode, ids), pa.binary())], schema=out)

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(freeing(each, forget), f"`{key}` long, n_tokens long, ids binary, bytes binary")


def sized(pairs: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list, list]]:
    """Keys and values in lists of about BATCH_BYTES."""
    keys, values, size = [], [], 0
    for k, v in pairs:
        keys.append(k)
        values.append(v)
        size += len(v) + 32
        if size >= BATCH_BYTES:
            yield keys, values
            keys, values, size = [], [], 0
    if keys:
        yield keys, values


