"""Token ids in patched frame-of-reference segments.

A segment holds the ids of some documents: a header, how many ids each document has, an index of block starts, and blocks
of BLOCK ids. A block stores its minimum, a width that fits a percentile of the differences from it, all differences cut
to that width bit by bit, and an exception list: the place and the missing high bits of each difference beyond the width.

write() deals documents out by ranges of ascending id, encodes and packs them in the same task, and leaves the segments to
Spark's Parquet writer, whose commits survive lost executors on any store; segments are rows of (part, segment, first_doc,
n_docs, n_ids, docs, payload). read() gives one row per document from them.

Defined results: a null text is empty and has the end id alone; a null id sorts first; equal ids come in the order of their
texts' hashes; an empty table gives no segments and no rows. Only the named columns are read.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, shared_dir

# Fixed values of the segment format.
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sIIQ")  # magic, documents, blocks, ids
BLOCK_HEAD = struct.Struct("<IBHH")  # minimum, width, ids, exceptions

BLOCK = 512
PERCENTILE = 95.0
SEGMENT_IDS = 1 << 19
#: Blocks that a reader opens at once, if no document is longer.
MOST_BLOCKS = 1024
#: Words kept with their ids in a Python worker, and the characters that are encoded together.
MEMO, BATCH_CHARS = 1_000_000, 8 << 20
#: What the end of a word is cut at: marks that the tokenizer parts from a letter or digit before them.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DOTTED_I = "\u0130"  # its lower case ends with a mark


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each of width bits, as rows of bytes: bit j of value i is bit i * width + j. 64 values fill width words
    of 64 bits, and the same place of all 64s is set at once."""
    n = values.shape[1]
    lanes = np.zeros((len(values), -(-n // 64), 64), np.uint64)
    lanes.reshape(len(values), -1)[:, :n] = values
    out = np.zeros((len(values), lanes.shape[1], width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= lanes[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1).astype("<u8", copy=False).view(np.uint8)[:, : (n * width + 7) // 8]


def unpacked_bits(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """The rows of n values that packed_bits made."""
    groups = -(-n // 64)
    held = np.zeros((len(data), groups * width * 8), np.uint8)
    held[:, : data.shape[1]] = data
    words = held.view("<u8").astype(np.uint64, copy=False).reshape(len(data), groups, width)
    out = np.zeros((len(data), groups, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        x = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, i] = x & mask
    return out.reshape(len(data), -1)[:, :n]


def packed_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of rows of equally many ids."""
    n = ids.shape[1]
    low = ids.min(axis=1).astype(np.uint64)
    rest = ids.astype(np.uint64) - low[:, None]
    place = -int(-percentile * (n - 1) // 100)
    fits = np.partition(rest, place, axis=1)[:, place]
    widths = np.searchsorted(np.uint64(1) << np.arange(33, dtype=np.uint64), fits, side="right")
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        high = rest[rows] >> np.uint64(width)
        bits = packed_bits(rest[rows] & np.uint64((1 << width) - 1), width)
        row, far = np.nonzero(high)
        ends = np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
        far_bytes, high_bytes = far.astype("<u2").tobytes(), high[row, far].astype("<u4").tobytes()
        for k, i in enumerate(rows.tolist()):
            a, b = ends[k], ends[k + 1]
            out[i] = BLOCK_HEAD.pack(int(low[i]), width, n, b - a) + bits[k].tobytes() + far_bytes[2 * a : 2 * b] + high_bytes[4 * a : 4 * b]
    return out


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    return packed_blocks(np.asarray(ids, np.uint32)[None, :], percentile)[0]


def unpack_blocks(data: memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that start at these places (the last is the end); blocks of one width and size are undone at once."""
    heads = [BLOCK_HEAD.unpack_from(data, at) for at in starts[:-1].tolist()]
    low, width, n, far = (np.array(x, np.int64) for x in zip(*heads, strict=True))
    ends, raw = np.cumsum(n), np.frombuffer(data, np.uint8)
    out, begin = np.empty(int(ends[-1]), np.uint32), ends - n
    at = starts[:-1].astype(np.int64) + BLOCK_HEAD.size
    for w, m in sorted(set(zip(width.tolist(), n.tolist(), strict=True))):
        rows, size = np.flatnonzero((width == w) & (n == m)), (m * w + 7) // 8
        rest = unpacked_bits(raw[at[rows][:, None] + np.arange(size)], w, m)
        for k in np.flatnonzero(far[rows]).tolist():
            i = rows[k]
            places = np.frombuffer(data, "<u2", far[i], at[i] + size)
            rest[k, places] |= np.frombuffer(data, "<u4", far[i], at[i] + size + 2 * far[i]).astype(np.uint64) << np.uint64(w)
        out[begin[rows][:, None] + np.arange(m)] = (rest + low[rows].astype(np.uint64)[:, None]).astype(np.uint32)
    return out


def unpack_block(data: memoryview) -> np.ndarray:
    return unpack_blocks(memoryview(data), np.array([0, len(data)]))


def pack(documents: list[np.ndarray], block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """A segment of the ids of documents."""
    ids = np.concatenate([*documents, np.empty(0, np.uint32)]).astype(np.uint32)
    whole = len(ids) // block * block
    blocks = packed_blocks(ids[:whole].reshape(-1, block), percentile) if whole else []
    if whole < len(ids):
        blocks.append(pack_block(ids[whole:], percentile))
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return HEAD.pack(MAGIC, len(documents), len(blocks), len(ids)) + np.array([len(d) for d in documents], "<u4").tobytes() + starts.tobytes() + b"".join(blocks)


class Segment:
    """Reads a segment; a range of ids opens only the blocks that hold it."""

    def __init__(self, data: bytes):
        magic, docs, blocks, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment")
        self.counts = np.frombuffer(data, "<u4", docs, HEAD.size)
        at = HEAD.size + 4 * docs
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at)
        self.body = memoryview(data)[at + 8 * (blocks + 1) :]
        self.block = BLOCK_HEAD.unpack_from(self.body)[2] if blocks else 1

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n if end is None else end
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        found = unpack_blocks(self.body, self.starts[first : last + 2])
        return found[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, in order, with few blocks open at a time."""
        at, held, base = 0, np.empty(0, np.uint32), 0
        for n in self.counts.tolist():
            if at + n - base > len(held):
                base, held = at, self.ids(at, min(self.n, max(at + n, at + MOST_BLOCKS * self.block)))
            yield held[at - base : at - base + n]
            at += n


def lowered(texts: pa.StringArray) -> pa.StringArray:
    """The texts with A-Z in lower case, as the tokenizer has them, but for those in which that could matter to steps before
    it: a special token ("<|") or a letter that has a composed form in one case only."""
    low = pc.ascii_lower(texts)

    def same(a: str, b: str) -> bool:
        return "<|" not in a and (a.isascii() or unicodedata.is_normalized("NFC", a) and unicodedata.is_normalized("NFC", b))

    return pc.if_else(pa.array(map(same, texts.to_pylist(), low.to_pylist()), pa.bool_()), low, texts)


def cut_marks(words: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray]:
    """Words without the marks at their end, and these marks; empty where the word must stay whole."""
    base = pc.utf8_rtrim(words, characters=MARKS)
    last = pc.utf8_slice_codeunits(base, -1)
    letter = pc.and_(pc.utf8_is_alpha(last), pc.less_equal(pc.binary_length(last), 2))
    plain = pc.or_(pc.ascii_is_alnum(last), pc.and_(letter, pc.not_equal(last, DOTTED_I)))
    cut = pc.and_(plain, pc.invert(pc.match_substring(words, "<|")))
    base = pc.if_else(cut, base, words)
    sizes = pc.utf8_length(base).to_numpy()
    at = np.flatnonzero(pc.utf8_length(words).to_numpy() > sizes)
    marks = np.full(len(words), "", object)
    marks[at] = [w[n:] for w, n in zip(words.take(pa.array(at)).to_pylist(), sizes[at].tolist(), strict=True)]
    return base, pa.array(marks, pa.string())


class WordEncoder:
    """The library's ids of texts, word by word.

    The tokenizer's own steps never join what white space parts and drop the space, and they part a letter or digit from the
    marks behind it; so a text's ids are those of its words and marks in turn. Texts are cut up in whole batches, only the
    different words of a batch are looked up, and those met before are not encoded again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        #: number of each known word; word k has the ids starts[k] to starts[k + 1] of the pool
        self.memo: dict[str, int] = {"": 0}
        self.starts, self.pool = np.zeros(2, np.int64), np.empty(0, np.uint32)

    def ids(self, words: list[str]) -> list[np.ndarray]:
        """A word of letters is one piece, whose last token alone ends a word; so many are one input to the library."""
        out: list[np.ndarray | None] = [None] * len(words)
        letters = [k for k, w in enumerate(words) if w.isalpha()]
        lists = [letters[i : i + 512] for i in range(0, len(letters), 512)]
        for part, e in zip(lists, self.tokenizer.encode_batch_fast([" ".join([words[k] for k in part]) for part in lists], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):  # else normal forms made marks of letters
                for k, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    out[k] = ids[a:b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.uint32)
        return out

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of words, new ones being learned."""
        new = [w for w in words if w not in self.memo]
        if new:
            found, first = self.ids(new), len(self.memo)
            self.memo.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in found])])
            self.pool = np.concatenate([self.pool, *found])
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.StringArray | list[str], end_id: int) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = pc.ascii_split_whitespace(lowered(texts))
        coded = parts.flatten().dictionary_encode()
        bases, marks = cut_marks(coded.dictionary)
        known = len(self.memo)
        pieces = np.stack([self.numbers_of(bases), self.numbers_of(marks)], axis=1)[coded.indices.to_numpy()].ravel()
        sizes = self.starts[pieces + 1] - self.starts[pieces]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[pieces] - (ends - sizes), sizes) + np.arange(total)]
        cuts = np.concatenate([[0], ends])[2 * parts.offsets.to_numpy()]
        out = np.empty(total + len(texts), np.uint32)
        close = cuts[1:] + np.arange(len(texts))
        inside = np.ones(len(out), bool)
        inside[close] = False
        out[inside], out[close] = ids, end_id
        if len(self.memo) > max(known, MEMO):  # it keeps the words it has
            for w in list(self.memo)[max(known, MEMO) :]:
                del self.memo[w]
            self.starts = self.starts[: len(self.memo) + 1]
            self.pool = self.pool[: self.starts[-1]]
        return np.split(out, close[:-1] + 1) if len(texts) else []

    def numbers_of(self, words: pa.StringArray) -> np.ndarray:
        coded = words.dictionary_encode()
        return self.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]


ENCODERS: dict[str, WordEncoder] = {}  # of this Python worker


def write(df: DataFrame, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", to: str | None = None, parts: int | None = None) -> str:
    """Write the segments of all rows in ascending order of key; gives the folder they are in."""
    spark = df.sparkSession
    to = to or f"{shared_dir(spark)}/tideframe/tokens-{uuid.uuid4().hex}"
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("payload", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in ENCODERS:
            ENCODERS[path] = WordEncoder(path)
        part, n, docs, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "segment": n, "n_ids": size, "docs": docs, "payload": pack(held)}], out)

        for ids, texts in grouped(batches):
            for k, x in zip(ids.to_pylist(), ENCODERS[path].encode(texts, end_id), strict=True):
                docs.append(k)
                held.append(x)
                size += len(x)
                if size >= SEGMENT_IDS:
                    yield full()
                    n, docs, held, size = n + 1, [], [], 0
        if docs:
            yield full()

    rows = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange(parts, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")  # h parts a hot id
    dealt.mapInArrow(each, "part int, segment int, n_ids long, docs array<bigint>, payload binary").write.parquet(to)
    return to


def grouped(batches: Iterator[pa.RecordBatch], size: int = BATCH_CHARS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of as many rows as hold about `size` bytes of text."""
    held, held_size = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)) if b.num_rows else []
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(b.num_rows, int(np.searchsorted(ends, before + size - held_size)) + 1)
            held.append(b.slice(at, to - at))
            held_size += int(ends[to - 1]) - before
            at = to
            if held_size >= size:
                yield joined(held)
                held, held_size = [], 0
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(i) for b in batches]) for i in (0, 1))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """key doc_id (long), start (long: ids of all documents before it), n_tokens (long) and ids (binary, little-endian
    unsigned 32-bit) of each document in a folder that write() made. The starts, a row per segment, are broadcast to the
    segments where these are FEW at most."""
    schema = "part int, segment int, n_ids long, docs array<bigint>, payload binary"
    segments = spark.read.schema(schema).parquet(folder)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    within = segments.select("part", "segment", "n_ids").withColumn("seg_start", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids"))
    starts = within.join(before, F.col("part") == F.col("p")).select("part", "segment", (F.col("seg_start") + F.col("part_start")).alias("start"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, payload, start in zip(*b.columns, strict=True):
                at, names, held, size = start.as_py(), docs.as_py(), [], 0
                for k, ids in zip(names, Segment(payload.as_py()).documents(), strict=True):
                    held.append((k, at, len(ids), ids.tobytes()))
                    at += len(ids)
                    size += len(ids)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    if segments.count() <= FEW:
        starts = F.broadcast(starts)
    return segments.join(starts, ["part", "segment"]).select("docs", "payload", "start").mapInArrow(each, "doc_id long, start long, n_tokens long, ids binary")
