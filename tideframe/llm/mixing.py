"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut by a hash of its documents into BLOCKS blocks. A source's target says how many words the mix takes of it:
whole passes over all its blocks, and in the last pass the first blocks of a random order, with the one block that the
target cuts taken document by document: it is cut by the next bits of the hash, so that only a small part of it is put in
order. A block in a pass is one draw. The tree deals the draws out to the output shards:
at each node the draws that the node holds, counted by source, are split into the exact number that the left half of its
shards takes and the rest, with the counts by source from a multivariate-hypergeometric draw. So the shards' counts are
those of a random deal of all draws, yet only counts are dealt: a shard's draws are a range of each source's order, and the
ranges are disjoint. Within a shard the documents are put into a random order by a hash.

All chance comes from seed and hashes, so reruns agree. What the driver holds is a row of counts for each source.

Defined results: null texts have size 0; the null source is a source like the others, last in order; sources whose words
are 0 have target 0; equal rows are drawn alike, each by itself; an empty table gives no rows. Only the named columns are
used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

BLOCKS = 512
SHARDS = 64
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 20240607
#: Plans of at most so many rows are broadcast.
BROADCAST_BLOCKS = 50_000


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = MOST) -> np.ndarray:
    """Shares of total by weight, none above most times its size; what is over is shared again by weight among the rest."""
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = min(total, most * float(sizes.sum()))
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def split_tree(draws: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Counts by (shard, source) that add up to draws, shards as even as can be."""
    total = int(draws.sum())
    sizes = np.array([total // shards + (i < total % shards) for i in range(shards)])
    out = np.zeros((shards, len(draws)), np.int64)

    def split(first: int, end: int, held: np.ndarray) -> None:
        if end - first == 1:
            out[first] = held
            return
        middle = (first + end) // 2
        left, want, rest = np.zeros_like(held), int(sizes[first:middle].sum()), int(held.sum())
        for i, n in enumerate(held.tolist()):  # one source after the other, each conditional on those before
            rest -= n
            left[i] = take = int(rng.hypergeometric(n, rest, want)) if want and n + rest else 0
            want -= take
        split(first, middle, left)
        split(middle, end, held - left)

    split(0, shards, np.asarray(draws, np.int64))
    return out


def blocks_of(docs: DataFrame, source: str, key: str, text: str, blocks: int, seed: int, row: F.Column | None = None) -> DataFrame:
    """doc_id, source, size, block and r, a hash for orders; and row where one is given."""
    more = [] if row is None else [row.alias("row")]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), *more)
    return rows.withColumn("r", F.xxhash64(F.lit(seed), "source", "doc_id")).withColumn("block", F.pmod("r", F.lit(blocks)).cast("int"))


def plan(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, blocks: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of each source: source, source_size, target, ends (of the ranges of its order of draws that the shards take) and
    n_blocks; and of each block: source, block, copies (draws of the whole block), cut (words of its part in the last pass,
    or null) and its place in the order."""
    spark = sized.sparkSession
    by_block = written(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "mixing-blocks")
    by_source = by_block.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect()
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = np.array([r["words"] for r in by_source], np.float64)
    want = targets(words, np.array([weights[i % len(weights)] for i in range(len(words))]), share * float(words.sum()), most)
    known = spark.createDataFrame([(r["source"], int(r["words"]), float(t), int(t // r["words"]) if r["words"] else 0) for r, t in zip(by_source, want, strict=True)], "source string, source_size long, target double, passes long")
    same = F.col("b.source").eqNullSafe(F.col("k.source"))
    order = Window.partitionBy("b.source").orderBy(F.xxhash64(F.lit(seed + 1), "b.block"), "b.block")
    placed = by_block.alias("b").join(known.alias("k"), same).select("b.source", "b.block", "b.words", "source_size", "target", "passes", F.row_number().over(order).alias("place"), F.sum("b.words").over(order).alias("upto"))
    left = F.col("target") - F.col("passes") * F.col("source_size")
    whole, part = (left > 0) & (F.col("upto") <= left), (F.col("upto") > left) & (F.col("upto") - F.col("words") < left)
    drawn = placed.withColumn("copies", F.col("passes") + whole.cast("long")).withColumn("cut", F.when(part, left - (F.col("upto") - F.col("words"))))
    drawn = written(drawn.select("source", "block", "copies", "cut", "place"), "mixing-draws")
    counts = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.sum(F.col("copies") + F.col("cut").isNotNull().cast("long")).alias("n")).collect()}
    per_shard = split_tree(np.array([counts.get(r["source"], 0) for r in by_source], np.int64), shards, np.random.default_rng(seed))
    ends = np.cumsum(per_shard, axis=0)
    ranges = spark.createDataFrame([(r["source"], int(r["words"]), float(t), ends[:, i].tolist(), int(r["n"])) for i, (r, t) in enumerate(zip(by_source, want, strict=True))], "source string, source_size long, target double, ends array<bigint>, n_blocks long")
    return ranges, drawn


def block_plan(held: DataFrame, weights: tuple[float, ...], share: float, most: float, blocks: int, shards: int, seed: int) -> DataFrame:
    """A row for each block, with all that a document of it needs to know its draws."""
    ranges, drawn = plan(held, weights, share, most, blocks, shards, seed)
    # the one cut block of a source is a BLOCKS-th of it: its documents are taken in the order of their hash while half of
    # the next one fits at least. Sums over the top bits of the hash say in which parts of the block that end may lie
    edge = held.join(drawn.where("cut is not null").select(F.col("source").alias("bs"), F.col("block").alias("bb"), "cut"), same_block())
    edge = written(edge.select("source", "size", "r", "doc_id", "cut", F.shiftright("r", 54).alias("part")), "mixing-edge")
    sums = edge.groupBy("source", "part", "cut").agg(F.sum("size").alias("words"))
    by_part = Window.partitionBy("source").orderBy("part")
    reached = sums.withColumn("base", F.sum("words").over(by_part) - F.col("words")).where("base <= cut")
    ends = reached.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("part")))).where("nth <= 2").select(F.col("source").alias("ps"), F.col("part").alias("pp"), "base")
    near = edge.join(ends, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("pp")))
    upto = F.sum("size").over(Window.partitionBy("source", "part").orderBy("r", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
    last = near.withColumn("upto", upto).where("upto - size / 2D <= cut").groupBy("source").agg(F.max(F.struct("r", "doc_id", "size")).alias("last"))
    by_block = drawn.join(last.withColumnRenamed("source", "es"), F.col("source").eqNullSafe(F.col("es")), "left").join(ranges.withColumnRenamed("source", "rs"), F.col("source").eqNullSafe(F.col("rs")))
    out = written(by_block.select(F.col("source").alias("bs"), F.col("block").alias("bb"), "copies", "cut", "last", "place", "ends", "n_blocks", "source_size", "target"), "mixing-plan")
    drop_written(edge, drawn)
    return out


def same_block() -> F.Column:
    return F.col("source").eqNullSafe(F.col("bs")) & (F.col("block") == F.col("bb"))


def drawn_rows(rows: DataFrame, by_block: DataFrame) -> DataFrame:
    """rows (with doc_id, source, size, block and r), n (copies) and shards. A plan of at most BROADCAST_BLOCKS rows is
    broadcast, else both sides are shuffled by source and block."""
    few = by_block.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    more = F.when(F.col("cut").isNotNull() & (F.struct("r", "doc_id", "size") <= F.col("last")), 1).otherwise(0)
    full = rows.join(F.broadcast(by_block) if few else by_block, same_block()).withColumn("n", (F.col("copies") + more).cast("long"))
    # number of the draw in pass p: all blocks of the passes before, then the block's place
    numbers = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda p: (p - 1) * F.col("n_blocks") + F.col("place"))
    shard = F.when(F.col("n") > 0, F.transform(numbers, lambda d: F.size(F.filter(F.col("ends"), lambda e: e < d)))).otherwise(F.array().cast("array<int>"))
    return full.withColumn("shards", shard).drop("bs", "bb", "copies", "cut", "last", "place", "ends", "n_blocks")


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (long) and shards (array of the output shard of each copy).

    most must be whole. A document is in at most most draws.
    """
    held = written(blocks_of(docs, source, key, text, blocks, seed), "mixing-sizes")
    full = drawn_rows(held, block_plan(held, weights, share, most, blocks, shards, seed))
    return full.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"), "shards")


def drawn_documents(docs: DataFrame, source: str, key: str, text: str, weights: tuple[float, ...], share: float, most: float, blocks: int, shards: int, seed: int) -> DataFrame:
    """row (a struct of the columns of docs), doc_id, shard and copy of each copy that the mix takes."""
    held = written(blocks_of(docs, source, key, text, blocks, seed), "mixing-sizes")
    by_block = block_plan(held, weights, share, most, blocks, shards, seed)
    drop_written(held)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    full = drawn_rows(blocks_of(docs, source, key, text, blocks, seed, row), by_block)
    return full.where("n > 0").select("row", "doc_id", F.posexplode("shards").alias("copy", "shard"))


def mixed_documents(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with shard and copy as the columns _shard and _copy; docs that have
    such columns raise ValueError."""
    if {"_shard", "_copy"} & set(docs.columns):
        raise ValueError("the columns _shard and _copy are results")
    return drawn_documents(docs, source, key, text, weights, share, most, blocks, shards, seed).select("row.*", F.col("shard").alias("_shard"), F.col("copy").alias("_copy"))


def shuffled_documents(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it: each shard in one partition and in the order of shard_rows."""
    copies = drawn_documents(docs, source, key, text, weights, share, most, blocks, shards, seed)
    at = F.xxhash64(F.lit(seed + 2), "doc_id", "copy")
    return copies.repartition("shard").sortWithinPartitions("shard", at, "doc_id", "copy").select("row.*")


def shard_rows(mix: DataFrame, seed: int = SEED) -> DataFrame:
    """A row (doc_id, source, shard, copy, at) for each copy, at its random place within its shard."""
    copies = mix.select("doc_id", "source", F.posexplode("shards").alias("copy", "shard"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "copy"), "doc_id", "copy")
    return copies.withColumn("at", F.row_number().over(order))
