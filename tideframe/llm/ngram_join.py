"""Exact n-gram Jaccard join by a token-group matrix.

Texts with equal shingle sets form a class; the first of its rows stands for it and its number names it. A class's set is cut
by hash value into segments, so many that sets over the wanted similarity must agree in several of them; the hash of a segment
is one of the class's tokens. Tokens are dealt out once, and those that only one class has go no further. Similar classes form groups: each class joins the neighbour that shares most tokens with all others. The
matrix holds each group's token union, as rows (token, group); a join with the classes' own tokens counts how many of them
a group has, which bounds the overlap with any member. Only groups with enough are opened.

Opened groups are first compared with their leader, a pair for each class. What a leader links is one component already,
so only pairs with a class outside it remain; these are compared in blocks of bounded size. Sizes and intersections are
those of the whole sets of 64-bit shingle hashes.

Two sets link when 100 * intersection >= percent * union. The components are found by labels that spread over the links.

Defined results: null texts and texts without words have an empty set and link with nothing, not even each other; fewer
words than a shingle has are one shingle; equal rows are equal documents and share a component; a null id counts as no id,
and its component is the smallest id that it reaches, or null; an empty table gives no rows. Only the named columns are
used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, drop_written, few, freeing, written

BLOCK = 1024  # classes on a side of one block of comparisons
#: Tokens that a HOT_SHARE of about SAMPLE sampled rows have are counted apart from the others.
SAMPLE, HOT_SHARE = 10_000, 0.01


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Bytes that are hashed at once, longest words of which are left to xxhash; weights of the bytes; powers of an odd number and
#: of its inverse, so that the sum over a word doesn't tell where it stands.
PIECE = 1 << 18
BYTES = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
ODD = 0xD6E8FEB86659FD93
POWERS, INVERSES = (np.multiply.accumulate(np.array([1] + [x] * PIECE, np.uint64)) for x in (ODD, pow(ODD, -1, 1 << 64)))
IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, all bytes at once."""
    if len(data) <= PIECE:
        return piece_hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            end = max(data.rfind(c, at, end) for c in SPACES.encode())
            if end <= at:  # a word as long as the piece
                found = SPACE.search(data, at + 1)
                end = found.start() if found else len(data)
                out.append(np.array([xxhash.xxh64_intdigest(w) for w in data[at:end].split()], np.uint64))
                at = end
                continue
        out.append(piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def piece_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    outside = np.ones(len(b) + 2, bool)
    outside[1:-1] = IS_SPACE[b]
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTES[b] * POWERS[: len(b)], out=sums[1:])
    found = mixed((sums[ends] - sums[starts]) * INVERSES[starts])
    for k in np.flatnonzero(ends - starts >= PIECE - 1).tolist():
        found[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]])
    return found


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; bytes.lower knows ASCII letters only."""
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    n = min(size, len(h))
    found = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        found = mixed(found + h[i : len(h) - n + 1 + i])
    return np.unique(found)


def bands(percent: int) -> np.ndarray:
    """Lower ends of size bands such that a set's partners lie in its own band or the next one up or down."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 100 // percent + 1)
    return np.array(ends)


def differences(high: int, percent: int) -> int:
    """In how many elements sets of less than high elements can differ at most."""
    return 2 * (int(high) - 1) * (100 - percent) // (100 + percent)


def segments(tag: int, ends: np.ndarray, percent: int) -> tuple[int, int]:
    """Number of segments under a tag, and how many of them agree at least; 0, 0 where only equal sets link.

    Sets of less than ends[tag + 1] elements differ in `most` elements at most, each of which spoils one segment. There are
    as many segments more as are rarely empty together in a set of the band below.
    """
    most = differences(ends[tag + 1], percent)
    if most == 0:
        return 0, 0
    empty = (most + 4) * math.exp(-float(ends[max(tag - 1, 0)]) / (most + 4))
    spare = 2 + 2 * (most >= 8) + math.ceil(empty + 3 * math.sqrt(empty)) * (most >= 8)
    return most + spare, spare


def tokens(sets: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Segment hashes of a sorted set, for its own band and for the next, and how many of them any partner shares.

    Empty segments are left out where there are too few of them to make up the agreement. A set that gives them may have a
    partner that leaves out all but one of those in which they agree, so it asks for one.
    """
    out, need = [np.empty(0, np.uint64)], 1 << 20
    band = int(np.searchsorted(ends, len(sets), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets), dtype=np.uint64)])
    for tag in (band, band + 1):
        k, agree = segments(tag, ends, percent)
        if not k:
            continue
        part = ((sets >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        edge = np.searchsorted(part, np.arange(k + 1, dtype=np.uint64))
        full = np.flatnonzero(edge[1:] > edge[:-1])
        agree, full = (agree - k + len(full), full) if k - len(full) < agree else (1, np.arange(k))
        need = min(need, agree)
        out.append(mixed(mixed(sums[edge[full + 1]] - sums[edge[full]]) + np.uint64(tag << 40) + full.astype(np.uint64)))
    return np.concatenate(out), need


def text_hash(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sized(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n (set size), cls (binary, the set's 128-bit hash), need and tokens of each row."""
    ends = bands(percent)
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("need", pa.int32()), ("tokens", pa.list_(pa.int64()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, cls, need, toks = [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), size)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                told, least = tokens(s, ends, percent) if len(s) else (s, 0)
                need.append(least)
                toks.append(told.view(np.int64))
            flat = pa.array(np.concatenate([*toks, np.empty(0, np.int64)]))
            offsets = pa.array(np.cumsum([0, *map(len, toks)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(need, pa.int32()), pa.ListArray.from_arrays(offsets, flat)], schema=schema)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(freeing(each), "doc_id long, th long, n long, cls binary, need int, tokens array<bigint>")


def components(links: DataFrame) -> DataFrame:
    """v and label (the least vertex that links a, b reach) of each vertex with a link."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("j"), F.col("label").alias("far"))
        new = written(lower.join(jump, F.col("label") == F.col("j")).select("v", F.least("label", "far").alias("label"), (F.col("was") != F.least("label", "far")).alias("moved")), "labels")
        drop_written(labels)
        if new.where("moved").isEmpty():
            drop_written(both)
            return new.select("v", "label")
        labels = new.select("v", "label")


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of places of sets over the similarity."""
    vocabulary, where = np.unique(np.concatenate(right), return_inverse=True)
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    order = np.argsort(where, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(vocabulary)))])
    owner, sizes = owner[order], np.array([len(r) for r in right])
    for i, s in enumerate(left):
        at = np.searchsorted(vocabulary, s)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == s)]
        if not len(at):
            continue
        lengths = starts[at + 1] - starts[at]
        places = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[places], minlength=len(right))
        for j in np.flatnonzero(100 * shared >= percent * (len(s) + sizes - shared)).tolist():
            yield i, j


def hot_tokens(found: DataFrame) -> DataFrame:
    """hot: the tokens that many rows of a sample have. A sampled row has some hundred tokens, so these are some ten thousand at
    most; the choice only says how a token's classes are counted, not whether."""
    share = min(1.0, SAMPLE / max(1, found.count()))
    told = found.sample(share, seed=1).select(F.explode("tokens").alias("hot"))
    return told.groupBy("hot").agg(F.count("*").alias("n")).where(F.col("n") >= max(100, int(SAMPLE * HOT_SHARE))).select("hot")


def shared_tokens(found: DataFrame, copied: DataFrame) -> DataFrame:
    """v, token and c of the tokens that c > 1 classes have; found has cls, ref and tokens, copied the names of the classes of
    more than one row."""
    first = found.where("cls is not null").join(few(copied), F.col("cls") == F.col("same"), "left").where("name is null or name = ref")
    told = first.select(F.col("ref").alias("v"), F.explode("tokens").alias("token"))
    hot = written(hot_tokens(found), "hot-tokens")
    each = Window.partitionBy("token")
    if hot.isEmpty():
        counted = told.withColumn("c", F.count("*").over(each))
    else:
        marked = told.join(F.broadcast(hot), F.col("token") == F.col("hot"), "left")
        cold = marked.where("hot is null").select("v", "token").withColumn("c", F.count("*").over(each))
        many = marked.where("hot is not null").select("v", "token")
        sums = many.groupBy(F.col("token").alias("t")).agg(F.count("*").alias("c"))
        counted = cold.unionByName(many.join(F.broadcast(sums), F.col("token") == F.col("t")).select("v", "token", "c"))
    shared = written(counted.where("c > 1"), "shared-tokens")
    drop_written(hot)
    return shared


def links_of(found: DataFrame, rows: DataFrame, copied: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """a, b: links between classes, enough of them to connect all that links connect. Drops found."""
    shared = shared_tokens(found, copied)
    drop_written(found)
    # groups: each class goes to the neighbour that shares most tokens with all
    rank = shared.groupBy("v").agg(F.struct(F.sum("c").alias("s"), F.col("v").alias("x")).alias("rank"))
    ranked = shared.join(rank, "v")
    leaders = ranked.groupBy("token").agg(F.max("rank").alias("best")).withColumnRenamed("token", "t")
    member = ranked.join(leaders, F.col("token") == F.col("t")).groupBy("v").agg(F.max("best")["x"].alias("grp"))
    grouped = written(shared.select("v", "token").join(member, "v"), "grouped-tokens")
    # the matrix, and the bound of each class and group
    matrix = written(grouped.select(F.col("token").alias("t"), F.col("grp").alias("g")).distinct(), "token-groups")
    overlap = grouped.join(matrix, F.col("token") == F.col("t")).groupBy("v", "g").agg(F.count("*").alias("overlap"))
    wanted = written(shared.select("v").distinct().join(rows, F.col("v") == F.col("ref")).select(F.col("v").alias("c"), "need", F.col("cls").alias("digest"), F.col("doc_id").alias("wid"), F.col("th").alias("wth")), "wanted-classes")
    opened = written(overlap.join(few(wanted.select("c", "need")), F.col("v") == F.col("c")).where("overlap >= need").select("v", "g"), "opened-groups")
    drop_written(shared, grouped, matrix)

    # whole sets of the classes that are in question
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shingles(t.as_py(), size).tobytes() for t in b.column(2)]
            same = pa.array([xxhash.xxh3_128_digest(s) == d.as_py() for s, d in zip(got, b.column(1), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["c", "hashes"]).filter(same)

    texts = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_hash(text).alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    sets = texts.join(few(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth"))).select("c", "digest", "text").mapInArrow(freeing(whole), "c long, hashes binary").dropDuplicates(["c"])
    sets = written(sets, "sets")
    drop_written(wanted)
    # first each class with the leaders of its groups
    pairs = opened.where("v != g").join(sets, F.col("v") == F.col("c")).select("v", "g", F.col("hashes").alias("h1")).join(sets, F.col("g") == F.col("c")).select("v", "g", "h1", "hashes")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    near = written(pairs.mapInArrow(freeing(compared), "v long, g long").select(F.col("v").alias("a"), F.col("g").alias("b")), "leader-links")
    found = components(near)
    label = found.withColumnRenamed("v", "lv")
    # then what the leaders leave open: groups that hold more than one component
    state = opened.join(label, F.col("v") == F.col("lv"), "left").select("v", "g", F.coalesce("label", "v").alias("label"))
    main = label.select(F.col("lv").alias("mv"), F.col("label").alias("ml"))
    state = state.join(main, F.col("g") == F.col("mv"), "left").select("v", "g", "label", (F.col("label") == F.coalesce("ml", "g")).alias("inside"))
    state = written(state, "open-groups")
    drop_written(found, opened)
    size_of = state.groupBy("g").agg(F.count_if(~F.col("inside")).alias("n_left"), F.count("*").alias("n_right")).where("n_left > 0").withColumnRenamed("g", "sg")
    size_of = written(size_of, "open-group-sizes")
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    todo = state.join(few(size_of), F.col("g") == F.col("sg")).withColumn("nl", F.ceil(F.col("n_left") / BLOCK)).withColumn("nr", F.ceil(F.col("n_right") / BLOCK))
    to_left = todo.where("not inside").select("v", "g", "label", (place % F.col("nl")).alias("bl"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("br"), F.lit(True).alias("asks"))
    to_right = todo.select("v", "g", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1)).alias("bl"), (place % F.col("nr")).alias("br"), F.lit(False).alias("asks"))
    dealt = to_left.unionByName(to_right).join(sets, F.col("v") == F.col("c")).select("g", "bl", "br", "asks", "v", "label", "hashes")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of one block between classes that it doesn't know to be connected."""
        top = {x: x for x in pdf["label"].tolist()}

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        left, right = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        sets_l, sets_r = ([np.frombuffer(h, np.uint64) for h in side["hashes"]] for side in (left, right))
        found = []
        if sets_l and sets_r:
            ll, rl, lc, rc = (c.tolist() for c in (left["label"], right["label"], left["v"], right["v"]))
            for i, j in linked(sets_l, sets_r, percent):
                x, y = find(ll[i]), find(rl[j])
                if x != y:
                    top[max(x, y)] = min(x, y)
                    found.append((lc[i], rc[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    links = written(near.union(dealt.groupBy("g", "bl", "br").applyInPandas(block, "a long, b long")), "class-links")
    drop_written(near, state, size_of, sets)
    return links


def labelled(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text), n and label (of its component; null: no words) of each row."""
    found = written(sized(docs, key, text, size, percent).withColumn("ref", F.monotonically_increasing_id()), "shingle-tokens")
    rows = written(found.drop("tokens"), "shingle-classes")
    copied = written(rows.where("cls is not null").groupBy(F.col("cls").alias("same")).agg(F.min("ref").alias("name"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "copied-classes")
    links = links_of(found, rows, copied, docs, key, text, size, percent)
    tops = components(links)
    named = rows.join(few(copied), F.col("cls") == F.col("same"), "left").withColumn("name", F.when(F.col("cls").isNotNull(), F.coalesce("name", "ref")))
    out = written(named.join(few(tops), F.col("name") == F.col("v"), "left").select("doc_id", "th", "n", F.coalesce("label", "name").alias("label")), "shingle-labels")
    drop_written(rows, copied, links, tops)
    return out


def least_of_many(known: DataFrame, by: F.Column, least: str) -> DataFrame:
    """l and the least `by` of each label that more than one row bears, from a written table."""
    return written(known.where("label is not null").groupBy(F.col("label").alias("l")).agg(F.min(by).alias(least), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "least-of-labels")


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of each row."""
    rows = labelled(docs, size, percent, key, text)
    least = least_of_many(rows, F.col("doc_id"), "component")
    return rows.join(few(least), F.col("label") == F.col("l"), "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: that of the least id, no id being the last, and of the least text hash
    among equal ids. Documents without words stay, but of those alike in id and text one, unless they have no id."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    known = labelled(docs, size, percent, key, text)
    ranked = known.where("label is not null").withColumn("rank", rank)
    least = least_of_many(ranked, F.col("rank"), "least")
    gone = written(ranked.join(few(least), F.col("label") == F.col("l")).where("rank > least").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "near-copies")
    # of rows alike in id and text one stays; only these are numbered, so that other texts aren't shuffled
    alike = written(known.groupBy(F.col("doc_id").alias("same_id"), F.col("th").alias("same_th")).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "rows-alike")
    drop_written(known, least)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("id"), text_hash(text).alias("th"), F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    left = rows.join(few(gone), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left_anti")
    repeated = F.col("id").eqNullSafe(F.col("same_id")) & (F.col("th") == F.col("same_th"))
    if alike.isEmpty():
        return left.select("row.*")
    several = left.join(few(alike), repeated, "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("id", "th").orderBy("id")))
    return left.join(few(alike), repeated, "left_anti").select("row.*").union(several.where("nth = 1 or (id is null and not worded)").select("row.*"))
