"""Exact removal of repeated strings by suffix arrays that are built by induced sorting.

Every byte goes that a string of `length` bytes covers which starts anywhere else too, in any text or the same.

All windows of `length` bytes are dealt into ranges: consecutive windows whose least hash of a string of gram(length) bytes lies
at the same place, the anchor. Equal windows have equal anchors at the same offset, so only ranges whose anchor occurs twice matter.
Ranges that are equal as a whole get one name, as induced sorting names equal substrings; a name that occurs twice is repeated
throughout. What is left, the ranges at the rims of repeats, is cut into shards.

A shard holds the windows of one anchor whose offset lies in one of three classes, of the ranges that agree in the string which
all windows of the class hold; that string is one symbol there. Induced sorting makes the suffix array of many shards at once,
the permuted common prefixes with each suffix's neighbour follow from it, and those of a window's length are repeats. A shard of
more than MEMBERS ranges is cut again, by the symbols next to the string that they share, into eight classes of offsets, and
then by single offsets: there the shared string is the whole window. So no shard grows with the data, and none is left out.

The symbols are bytes or, for passages of so many words, the words' hashes: then white space doesn't count, and what goes is
the bytes from the first word to the last.

Hashes are of 64 bits, and a range's is compared within its anchor only.

Defined results: null texts are empty; texts shorter than `length` keep all; repeated rows are texts like others and so
repeat each other; bytes removed are judged on the input; an empty table gives no rows. Only the named columns are used, and
clean_documents passes the others through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, drop_written, freeing, written
from .common import rows as rows_of
from .ngram_join import word_hashes

LENGTH = 400
PASSAGE_WORDS = 51
#: Ranges of a shard at most, and symbols that are sorted at once (or a shard, if it has more).
MEMBERS, SORTED = 4096, 1 << 16
#: Ranges are looked for in so many bytes of symbols at once (or one text, if it has more); numpy takes some 60 times as much.
BATCH_BYTES = 1 << 20
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
TOP = np.uint64(2**64 - 1)


# --- suffix arrays ---------------------------------------------------------------------------------------------------


def suffix_array(text: list[int], symbols: int) -> list[int]:
    """Induced sorting; text ends with its only 0, and symbols is more than its largest."""
    n = len(text)
    smaller = bytearray(n)  # 1: the suffix is smaller than the next one
    smaller[n - 1] = 1
    for i in range(n - 2, -1, -1):
        a, b = text[i], text[i + 1]
        smaller[i] = a < b or (a == b and smaller[i + 1])
    leftmost = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]
    if n == 1:
        return [0]
    sizes = [0] * symbols
    for c in text:
        sizes[c] += 1
    order = induced(text, smaller, leftmost, sizes)
    # name the substrings between leftmost-smaller places, equal ones alike
    place = [-1] * n
    for k, i in enumerate(leftmost):
        place[i] = k
    names, name, before, ends = [0] * len(leftmost), -1, None, [*leftmost[1:], n - 1]
    for i in order:
        if (k := place[i]) >= 0:
            piece = text[i : ends[k] + 1]
            if piece != before or i == n - 1:
                name, before = name + 1, piece
            names[k] = name
    if name + 1 < len(leftmost):
        ranked = [leftmost[k] for k in suffix_array(names, name + 1)]
    else:
        ranked = [0] * len(leftmost)
        for k, x in enumerate(names):
            ranked[x] = leftmost[k]
    return induced(text, smaller, ranked, sizes)


def induced(text: list[int], smaller: bytearray, seeds: list[int], sizes: list[int]) -> list[int]:
    """Places of all suffixes, from the order of the seeds."""
    starts, ends, at = [], [], 0
    for s in sizes:
        starts.append(at)
        at += s
        ends.append(at)
    out, tail = [-1] * len(text), ends[:]
    for i in reversed(seeds):
        c = text[i]
        tail[c] = t = tail[c] - 1
        out[t] = i
    head = starts
    for i in out:  # larger suffixes from the left; the list grows into places not yet read
        if i > 0 and not smaller[i - 1]:
            c = text[i - 1]
            out[head[c]] = i - 1
            head[c] += 1
    tail = ends
    for k in range(len(out) - 1, -1, -1):
        i = out[k]
        if i > 0 and smaller[i - 1]:
            c = text[i - 1]
            tail[c] = t = tail[c] - 1
            out[t] = i - 1
    return out


def permuted_prefixes(text: list[int], order: list[int]) -> tuple[list[int], list[int]]:
    """For each place the common prefix with the suffix before it in the order, and that suffix's place (-1: none)."""
    n = len(text)
    before = [-1] * n
    for a, b in zip(order, order[1:], strict=False):
        before[b] = a
    found, h = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while text[i + h] == text[j + h]:  # the last symbols differ: each is its text's own
            h += 1
        found[i] = h
        if h:
            h -= 1
    return found, before


def repeated_starts(texts: list[np.ndarray], marks: list[int], groups: list[int], lengths: list[int]) -> list[np.ndarray]:
    """For each text (bytes or word hashes), the starts of its strings of its group's length that start elsewhere in texts of the
    group too, of those that hold the group's shared string: one symbol, before the text's symbol number marks[k], that no
    other group has. Without shared strings (marks -1) all groups are one."""
    m, own = len(texts), max(groups, default=0) + 1
    known, ranked = np.unique(np.concatenate(texts), return_inverse=True)
    base, ends = m + own + 1, np.cumsum([len(t) for t in texts])
    joined: list[int] = []
    begin, extra = [], [int(x >= 0) for x in marks]
    for k, t in enumerate(np.split(ranked + base, ends[:-1])):
        symbols = t.tolist()
        if extra[k]:
            symbols.insert(marks[k], m + 1 + groups[k])
        begin.append(len(joined))
        joined += symbols
        joined.append(k + 1)
    joined.append(0)
    prefixes, before = permuted_prefixes(joined, suffix_array(joined, base + len(known)))
    p, b = np.array(prefixes), np.array(before)
    sizes = np.array([len(t) for t in texts]) + np.array(extra) + 1
    need = np.repeat(np.array(lengths)[groups], sizes)
    long = p[:-1] >= need
    hit = np.zeros(len(joined), bool)
    hit[:-1] = long
    hit[b[:-1][long]] = True
    return [np.flatnonzero(hit[i : i + n - 1]) for i, n in zip(begin, sizes.tolist(), strict=True)]


# --- ranges ----------------------------------------------------------------------------------------------------------


def gram(length: int) -> int:
    """Size of an anchor's string: a power of two, at least half of the length and less than it."""
    return 1 << max((length - 1).bit_length() - 1, 0)


def classes(most: int, width: int) -> list[tuple[int, int]]:
    """Offsets 0 to most in classes of width: the first and last offset of each."""
    return [(a, min(a + width - 1, most)) for a in range(0, most + 1, width)]


def first_classes(length: int) -> list[tuple[int, int]]:
    """Three classes of the offsets of an anchor in its window."""
    most = length - gram(length)
    return classes(most, -(-(most + 1) // 3))


def byte_symbols(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def word_symbols(data: bytes) -> np.ndarray:
    return word_hashes(data)


Symbols = Callable[[bytes], np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    h, step, power = data.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while step < size:
        h = h[:-step] * power + h[step:]
        with np.errstate(over="ignore"):
            power, step = power * power, 2 * step
    return mixed(h)


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima of blocks in both directions."""
    n = len(h)
    blocks = np.concatenate([h, np.full(-n % w, TOP)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ranges(texts: list[np.ndarray], length: int) -> tuple[dict[str, np.ndarray], list[tuple[int, int, int]]]:
    """The ranges of texts of at least `length` symbols: text (place in the list), s and e (first and last start of its
    windows), p (place of the anchor), anchor, whole (hash of all its symbols), n (how often the text has it there), and c0 to c2,
    hashes of the strings that all its windows of an offset class hold (0: it has none). Where an anchor's string follows
    itself, ranges that a text has twice are told once; their windows are in the second list, as text, first and last start."""
    size = gram(length)
    w = length - size + 1
    data = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(data, size)
    least = window_least(h, w)
    valid = np.zeros(len(least) + 1, np.int32)
    np.add.at(valid, begin, 1)
    np.add.at(valid, begin + sizes - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    low = least[at]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
    s, e, anchor = at[new], np.concatenate([at[:-1][new[1:]], at[-1:]]), low[new]
    p, again = np.empty(len(s), np.int64), np.empty(len(s), bool)
    steps = np.arange(w)
    for i in range(0, len(s), 4096):
        c = slice(i, i + 4096)
        first, last = h[s[c][:, None] + steps] == anchor[c][:, None], h[e[c][:, None] + steps] == anchor[c][:, None]
        p[c] = s[c] + first.argmax(axis=1)
        again[c] = (first.sum(axis=1) > 1) | (last.sum(axis=1) > 1) | (e[c] + last.argmax(axis=1) != p[c])
    # where the least hash occurs again, a window belongs to the first place of it
    parts = [(s[~again], e[~again], p[~again], anchor[~again])]
    for i in np.flatnonzero(again).tolist():
        places = s[i] + np.flatnonzero(h[s[i] : e[i] + w] == anchor[i])
        starts = np.arange(s[i], e[i] + 1)
        q = places[np.searchsorted(places, starts)]
        cut = np.flatnonzero(np.diff(q, prepend=-1))
        parts.append((starts[cut], np.concatenate([starts[cut[1:]] - 1, [e[i]]]), q[cut], np.repeat(anchor[i], len(cut))))
    plain = len(parts[0][0])
    s, e, p, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    end = e + length - size
    whole = mixed(h[s] * MULTIPLIER + h[(s + end) // 2]) * MULTIPLIER + h[end] + (e - s).astype(np.uint64)
    text, n, sure = np.searchsorted(begin, s, side="right") - 1, np.ones(len(s), np.int64), []
    if plain < len(s):
        _, kind, back, times = np.unique(np.stack([text[plain:].astype(np.uint64), anchor[plain:], whole[plain:]]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        twice = plain + np.flatnonzero(times[back.ravel()] > 1)
        spans = merged(np.stack([s[twice], e[twice] + 1], axis=1))
        sure = [(int(k), int(x), int(y) - 1) for k, (x, y) in zip(np.searchsorted(begin, spans[:, 0], side="right") - 1, spans, strict=True)]
        kept = np.concatenate([np.arange(plain), plain + kind])
        n[plain + kind] = times
        s, e, p, anchor, whole, text, n = (x[kept] for x in (s, e, p, anchor, whole, text, n))
    out = {"text": text, "s": s - begin[text], "e": e - begin[text], "p": p - begin[text], "anchor": anchor, "whole": whole, "n": n}
    most = length - size
    for j, (d1, d2) in enumerate(first_classes(length)):
        there = (s <= p - d1) & (e >= p - d2)
        x, y = np.where(there, p - d1, 0), np.where(there, p + most - d2, 0)  # first and last string in what the class holds
        out[f"c{j}"] = np.where(there, mixed(h[x] * MULTIPLIER + h[y]) | np.uint64(1), np.uint64(0))
    return out, [(k, x - int(begin[k]), y - int(begin[k])) for k, x, y in sure]


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint spans (start, end) that don't touch, with the same places."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:], [True]])]], axis=1)


def runs(starts: np.ndarray, length: int) -> np.ndarray:
    return merged(np.stack([starts, starts + length], axis=1)) if len(starts) else np.empty((0, 2), np.int64)


# --- DataFrames ------------------------------------------------------------------------------------------------------

RANGE = "id long, th long, s int, e int, p int, anchor long, whole long, c0 long, c1 long, c2 long, n long"
RIM = "id long, th long, wa long, c long, most int, members long, copies long, s int, left binary, right binary"
SPAN = "id long, th long, a int, b int"


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, text and th, a hash of the text: together they name a row, or rows that are alike."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def found_ranges(rows: DataFrame, length: int, symbols: Symbols) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            r, sure = ranges([t for _, _, t in held], length)
            text = np.concatenate([r["text"], np.array([x[0] for x in sure], np.int64)])
            ids, th = (pa.array([x[k] for x in held], pa.int64()).take(pa.array(text)) for k in (0, 1))
            at = [pa.array(np.concatenate([r[c], np.array([x[k] for x in sure], np.int64)]).astype(np.int32)) for c, k in (("s", 1), ("e", 2), ("p", 1))]
            none = pa.nulls(len(sure), pa.int64())  # windows that the text itself repeats have no anchor
            rest = [pa.concat_arrays([pa.array(r[c].view(np.int64)), none]) for c in ("anchor", "whole", "c0", "c1", "c2", "n")]
            return pa.RecordBatch.from_arrays([ids, th, *at, *rest], names=[c.split()[0] for c in RANGE.split(", ")])

        for b in batches:
            for i, h, t in zip(*b.columns, strict=True):
                data = symbols(t.as_py().encode())
                if len(data) >= length:
                    held.append((i.as_py(), h.as_py(), data))
                    size += data.nbytes
                    if size >= BATCH_BYTES:
                        yield full()
                        held.clear()
                        size = 0
        if held:
            yield full()

    return rows.select("id", "th", "text").mapInArrow(freeing(each), RANGE)


def repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", symbols: Symbols = byte_symbols) -> DataFrame:
    """id, th and spans (array of structs a, b: symbols a to b, not merged) of the texts that hold repeats."""
    rows = keyed(docs, key, text)
    all_ranges = written(found_ranges(rows, length, symbols), "repeat-ranges")
    known = all_ranges.where("anchor is not null")
    twice = known.groupBy(F.col("anchor").alias("x")).agg(F.sum("n").alias("m")).where("m > 1").drop("m")
    twice = written(twice, "repeated-anchors")
    live = written(known.join(twice, F.col("anchor") == F.col("x")).drop("x"), "repeat-candidates")
    by_text = written(all_ranges.where("anchor is null").select("id", "th", F.col("s").alias("a"), (F.col("e") + length).alias("b")), "repeats-within-texts")
    drop_written(all_ranges, twice)
    # equal ranges: repeated throughout if there are two
    whole = live.groupBy(F.col("anchor").alias("wa"), F.col("whole").alias("ww")).agg(F.sum("n").alias("copies"), F.min(F.struct("id", "th", "s", "e", "p", "c0", "c1", "c2")).alias("one"))
    whole = written(whole, "repeat-wholes")
    sure = live.join(whole.where("copies > 1").select("wa", "ww"), (F.col("anchor") == F.col("wa")) & (F.col("whole") == F.col("ww")), "left_semi")
    sure = sure.select("id", "th", F.col("s").alias("a"), (F.col("e") + length).alias("b"))
    # different ranges of an anchor: classes in which two agree, if one of them isn't sure already
    parts = whole.select("wa", "copies", "one.*").select("wa", "copies", "id", "th", "s", "e", "p", F.posexplode(F.array("c0", "c1", "c2")).alias("j", "c")).where("c != 0")
    agreed = parts.groupBy(F.col("wa").alias("ga"), F.col("j").alias("gj"), F.col("c").alias("gc")).agg(F.count("*").alias("members"), F.count_if(F.col("copies") == 1).alias("open")).where("members > 1 and open > 0").drop("open")
    agreed = written(agreed, "repeat-classes")
    chosen = parts.join(agreed, (F.col("wa") == F.col("ga")) & (F.col("j") == F.col("gj")) & (F.col("c") == F.col("gc")))
    cuts = chosen.groupBy(F.col("id").alias("ci"), F.col("th").alias("ct")).agg(F.collect_list(F.struct("wa", "j", "c", "members", "copies", "s", "e", "p")).alias("cuts"))
    cut = written(rows.join(cuts, F.col("id").eqNullSafe(F.col("ci")) & (F.col("th") == F.col("ct"))).select("id", "th", "text", "cuts").mapInArrow(freeing(rims_cut(length, symbols)), RIM).dropDuplicates(["id", "th", "wa", "c", "s"]), "repeat-rims")
    spans = sure.union(by_text).union(sorted_shards(cut.where(F.col("members") <= MEMBERS), length, symbols))
    done, large = [live, whole, by_text, agreed, cut], cut.where(F.col("members") > MEMBERS)
    most = first_classes(length)[0][1]
    for width in sorted({-(-(most + 1) // 8), 1}, reverse=True):
        if large.isEmpty():
            break
        finer = written(large.mapInArrow(freeing(rims_cut_again(width, symbols)), RIM), "repeat-rims")
        groups = finer.groupBy(F.col("wa").alias("ga"), F.col("c").alias("gc")).agg(F.count("*").alias("m"), F.count_if(F.col("copies") == 1).alias("open")).where("m > 1 and open > 0").drop("open")
        cut = written(finer.join(groups, (F.col("wa") == F.col("ga")) & (F.col("c") == F.col("gc"))).withColumn("members", F.col("m")).select(*finer.columns), "repeat-rims")
        drop_written(finer)
        done.append(cut)
        if width == 1:  # the shared string is the window, so that all are repeats
            spans = spans.union(cut.where("copies = 1").select("id", "th", F.col("s").alias("a"), (F.col("s") + length).alias("b")))
        else:
            spans = spans.union(sorted_shards(cut.where(F.col("members") <= MEMBERS), length, symbols))
        large = cut.where(F.col("members") > MEMBERS)
    # rows alike tell the same spans
    out = written(spans.distinct().groupBy("id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "repeat-spans")
    drop_written(*done)
    return out


def told(kind: str, found: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*found, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def in_batches(kind: str, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) >= 10_000:
            yield told(kind, held)
            held = []
    if held:
        yield told(kind, held)


def rims_cut(length: int, symbols: Symbols) -> Batches:
    """Rows of RIM from texts and their cuts: what lies to the left and the right of the class's string, in the windows of the
    class that the range has. `most` is the length of a window less that of the string."""
    size, offsets = gram(length), first_classes(length)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(RIM, found(batches))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for i, h, t, cuts in rows_of(batches, "id", "th", "text", "cuts"):
            data = symbols(t.encode())
            for c in cuts:
                d1, d2 = offsets[c["j"]]
                p, first, last = c["p"], max(c["s"], c["p"] - d2), min(c["e"], c["p"] - d1)
                left, right = data[first : p - d1], data[p + size + length - size - d2 : last + length]
                yield i, h, c["wa"], c["c"] ^ c["j"], d2 - d1, c["members"], c["copies"], first, left.tobytes(), right.tobytes()

    return each


def rims_cut_again(width: int, symbols: Symbols) -> Batches:
    """Rows of RIM by classes of `width` offsets of the shared string: c names it with the symbols next to it."""
    kind = symbols(b"").dtype

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(RIM, found(batches))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for i, h, wa, c, most, _, copies, s, left, right in rows_of(batches, *[x.split()[0] for x in RIM.split(", ")]):
            left, right = np.frombuffer(left, kind), np.frombuffer(right, kind)
            for d1, d2 in classes(most, width):
                first, last = min(d2, len(left)), max(d1, most - len(right))  # offsets of the windows that it has
                if first < last:
                    continue
                near = left[len(left) - d1 :].tobytes(), right[: most - d2].tobytes()
                name = xxhash.xxh3_64_intdigest(b"%d %d " % (c, d1) + near[0] + near[1])
                yield i, h, wa, name - (1 << 63), d2 - d1, 0, copies, s + len(left) - first, left[len(left) - first : len(left) - d1].tobytes(), right[most - d2 : most - last].tobytes()

    return each


def sorted_shards(rims: DataFrame, length: int, symbols: Symbols) -> DataFrame:
    """SPAN of the repeats that shards of rims hold."""
    kind = symbols(b"").dtype

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; many shards are sorted at once."""
        return in_batches(SPAN, found(batches))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, group, size = [], -1, 0
        for _, shard in groupby(rows_of(batches, "wa", "c", "id", "th", "most", "copies", "s", "left", "right"), itemgetter(0, 1)):
            group += 1
            for _, _, i, h, most, copies, s, left, right in shard:
                held.append((group, i, h, most, copies, s, np.frombuffer(left, kind), np.frombuffer(right, kind)))
                size += len(held[-1][6]) + len(held[-1][7]) + 2
            if size >= SORTED:
                yield from repeated(held)
                held, group, size = [], -1, 0
        if held:
            yield from repeated(held)

    def repeated(held: list[tuple]) -> Iterator[tuple]:
        needs = {g: most + 1 for g, _, _, most, *_ in held}
        hits = repeated_starts([np.concatenate(x[6:8]) for x in held], [len(x[6]) for x in held], [x[0] for x in held], [needs[g] for g in range(len(needs))])
        for (_, i, h, _, copies, s, _, _), hit in zip(held, hits, strict=True):
            if copies == 1:
                for a, b in runs(hit, length).tolist():
                    yield i, h, s + a, s + b

    return rims.repartition("wa", "c").sortWithinPartitions("wa", "c").mapInArrow(freeing(each), SPAN)


def with_spans(docs: DataFrame, length: int, key: str, text: str, row: F.Column | None = None, words: int | None = None) -> DataFrame:
    """id, text and spans of each row of docs, and row where one is given. With words, word_spans (in words) are those of repeated
    passages of so many words."""
    rows = keyed(docs, key, text)
    if row is not None:
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), row.alias("row")).withColumn("th", F.xxhash64("text"))
    spans = repeats(docs, length, key, text)
    if words is not None:
        both = spans.withColumn("word_spans", F.lit(None).cast(spans.schema["spans"].dataType)).unionByName(repeats(docs, words, key, text, word_symbols).withColumnRenamed("spans", "word_spans"), allowMissingColumns=True)
        spans = both.groupBy("id", "th").agg(F.max("spans").alias("spans"), F.max("word_spans").alias("word_spans"))
    spans = spans.withColumnsRenamed({"id": "si", "th": "st"})
    return rows.join(spans, F.col("id").eqNullSafe(F.col("si")) & (F.col("th") == F.col("st")), "left").drop("si", "st", "th")


def kept_bytes(data: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def removed(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans (longest removed runs), kept_sha256 and removed (array of structs a, b) of each row. With
    words also n_passage_words, how many of its words lie in passages of so many words that start elsewhere too (these stay)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for b in batches:
            n, gone, count, sha, found, passages = [], [], [], [], [], []
            for t, x, y in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = t.as_py().encode()
                spans, in_words = (merged(np.array([(z["a"], z["b"]) for z in c.as_py() or []], np.int64).reshape(-1, 2)) for c in (x, y))
                n.append(len(data))
                gone.append(int((spans[:, 1] - spans[:, 0]).sum()))
                count.append(len(spans))
                sha.append(hashlib.sha256(kept_bytes(data, spans)).hexdigest())
                found.append([{"a": p, "b": q} for p, q in spans.tolist()])
                passages.append(int((in_words[:, 1] - in_words[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(found, kind), pa.array(passages, pa.int64())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "n_passage_words"])

    rows = with_spans(docs, length, key, text, words=words)
    if words is None:
        rows = rows.withColumn("word_spans", F.lit(None).cast(rows.schema["spans"].dataType))
    out = rows.select("id", "text", "spans", "word_spans").mapInArrow(freeing(each), f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:int,b:int>>, n_passage_words long")
    return out if words is not None else out.drop("n_passage_words")


def clean_documents(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """docs with the repeated strings cut out of the text, and with words also the repeated passages of so many words; a
    character that a cut would split stays whole. Null texts that hold nothing to cut stay null."""

    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans, word_spans in batches:
            yield pd.Series([cut_text(t, s, w) for t, s, w in zip(texts, spans, word_spans, strict=True)], dtype=object)

    cleaned = F.pandas_udf(each, "string")
    joined = with_spans(docs, length, key, text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), words)
    if words is None:
        joined = joined.withColumn("word_spans", F.lit(None).cast(joined.schema["spans"].dataType))
    pairs = [F.transform(c, lambda x: F.array(x["a"], x["b"])) for c in ("spans", "word_spans")]
    new = F.when(F.col("spans").isNull() & F.col("word_spans").isNull(), F.col("row")[text]).otherwise(cleaned("text", *pairs))
    return joined.withColumn("_new", new).select(*[F.col("_new").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def word_places(data: bytes) -> np.ndarray:
    """Start and end of each word."""
    return np.array([m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)], np.int64).reshape(-1, 2)


def cut_text(text: str, spans: object, word_spans: object = None) -> str:
    if spans is None and word_spans is None:
        return text
    data = text.encode()
    at = np.array([list(x) for x in spans] if spans is not None else [], np.int64).reshape(-1, 2)
    if word_spans is not None:
        places, told = word_places(data), merged(np.array([list(x) for x in word_spans], np.int64).reshape(-1, 2))
        at = np.concatenate([at, np.stack([places[told[:, 0], 0], places[told[:, 1] - 1, 1]], axis=1)])
    inside = lambda i: 0 < i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in merged(at).tolist():
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return kept_bytes(data, np.array(out, np.int64).reshape(-1, 2)).decode()
