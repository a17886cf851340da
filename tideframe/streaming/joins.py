"""The joins and windows over live streams. Times must be TIMESTAMP here, as watermarks don't take TIMESTAMP_NTZ; event()
casts. State is bounded by the watermarks on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def stream_interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lower: str, upper: str, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Pairs with right time in [left time + lower, left time + upper] (interval strings); how: inner, or leftOuter, which
    emits an unmatched row once the watermark says that nothing can come."""
    on = F.expr(f"{right_time} >= {left_time} + INTERVAL {lower} AND {right_time} <= {left_time} + INTERVAL {upper}")
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    return left.join(right, on, how)


def stream_window_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, size: str, slide: str | None, keys: list[tuple[str, str]]) -> DataFrame:
    """Pairs in the same window; a pair comes once for each window of both."""
    plain = lambda t: F.col(t).cast("timestamp_ntz").cast("timestamp")  # noqa: E731  the window carries the watermark from here on
    left = left.withColumn("w", F.window(left_time, size, slide or size)).withColumn(left_time, plain(left_time))
    right = right.withColumn("rw", F.window(right_time, size, slide or size)).withColumn(right_time, plain(right_time))
    on = F.col("w") == F.col("rw")
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    return left.join(right, on).drop("rw")


def stream_hopping(df: DataFrame, time: str, width: str, slide: str, offset: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Windows with closes on multiples of the slide: offset is (-width) mod slide, as Spark counts from the opens."""
    w = F.window(time, width, slide, offset)
    return df.groupBy(w.alias("w"), *keys).agg(*aggregates).withColumn("w_open", F.col("w.start")).withColumn("w_close", F.col("w.end")).drop("w")


def stream_sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates)


class LateSplitter:
    """A foreachBatch function that parts rows behind the watermark (largest time of the batches before, less delay) from
    the others, and hands both on. The marks of the last batches are kept in a folder, so that a restarted query goes on with
    them and a batch that is run again meets the mark that it met before."""

    def __init__(self, time: str, delay_seconds: int, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], folder: str):
        self.time, self.delay, self.on_time, self.late, self.folder = time, delay_seconds, on_time, late, folder

    def before(self, batch: DataFrame, epoch: int) -> int | None:
        """The watermark after the batch before this one."""
        path = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        known = batch.sparkSession.read.schema("mark long, epoch long").parquet(self.folder).where(F.col("epoch") < epoch)
        return known.agg(F.max("mark")).first()[0]

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        t, mark = F.unix_micros(F.col(self.time).cast("timestamp")), self.before(batch, epoch)
        held = batch.persist()
        behind = F.coalesce(t < mark, F.lit(False)) if mark is not None else F.lit(False)
        self.on_time(held.where(~behind), epoch)
        self.late(held.where(behind), epoch)
        top = held.agg((F.max(t) - self.delay * 1_000_000).alias("mark"), F.lit(epoch).cast("long").alias("epoch")).where("mark is not null")
        top.coalesce(1).write.mode("append").parquet(self.folder)
        held.unpersist()
