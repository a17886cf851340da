"""Windows over event time: hopping and tumbling, sliding, frames, sessions and counts.

Hopping windows are [o, c) with closes on multiples of the slide; a slide over the width leaves gaps. All operators take
whole-number ticks or timestamps (deltas in seconds then).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.functions.timeutil import ceil_div, floor_div, fresh, from_ticks, is_time, span, ticks
from tideframe.operators.interval import chunks


def hopping(df: DataFrame, time: str, width: float, slide: float) -> DataFrame:
    """A row for each window that holds the row, with w_open and w_close; tumbling is slide = width."""
    w, s, t = span(df, time, width), span(df, time, slide), ticks(df, time)
    first, last = floor_div(t, s) + 1, floor_div(t + w, s)  # closes c with t < c <= t + width
    k = fresh("_k", df)
    placed = df.withColumn(k, F.explode(F.when(first <= last, F.sequence(first, last))))
    close = F.col(k) * s
    return placed.withColumn("w_open", from_ticks(df, time, close - w)).withColumn("w_close", from_ticks(df, time, close)).drop(k)


def hopping_latest(df: DataFrame, time: str, width: float, slide: float, seq: str | None = None) -> DataFrame:
    """eval_ts, w_open, w_close: the one window that a time-driven clock reports at each distinct event time, or none.

    At an event, of the windows that closed since the event before, the last one that was ever opened is reported, also if
    it is empty; older ones never are.
    """
    w, s = span(df, time, width), span(df, time, slide)
    # one clock for the stream: distinct times, with the time before found over chunks of them so that no task holds all
    every = df.select(ticks(df, time).alias("t")).where("t is not null")
    times = every.distinct().withColumn("chunk", chunks(every, F.col("t").cast("decimal(38,6)")))
    tops = times.groupBy(F.col("chunk").alias("c")).agg(F.max("t").alias("top"))
    before = tops.select("c", F.lag("top").over(Window.orderBy("c")).alias("before"))
    prev = F.coalesce(F.lag("t").over(Window.partitionBy("chunk").orderBy("t")), F.col("before"))
    stepped = times.join(before, F.col("chunk") == F.col("c")).withColumn("prev", prev)
    t, p = F.col("t"), F.col("prev")
    close = F.least((ceil_div(t, s) - 1) * s, F.greatest(ceil_div(p, s) * s, floor_div(p + w, s) * s))
    return stepped.where(p.isNotNull()).withColumn("close", close).where("close >= prev").select(from_ticks(df, time, t).alias("eval_ts"), from_ticks(df, time, F.col("close") - w).alias("w_open"), from_ticks(df, time, F.col("close")).alias("w_close"))


def content_of(windows: DataFrame, df: DataFrame, time: str, *aggregates: Column, width: float | None = None) -> DataFrame:
    """windows (w_open, w_close, ...) with aggregates of df's rows in each; empty windows keep their row. Windows and rows meet in
    buckets of time: width is best that of the windows (default: a day, or 2^20 ticks)."""
    t = F.col(time)
    keys = windows.select("w_open", "w_close").distinct()
    bucket = max(1, span(df, time, width)) if width else 86_400_000_000 if is_time(df, time) else 1 << 20
    lo, hi = ticks(keys, "w_open"), ticks(keys, "w_close")
    b, rb = fresh("_b", df), fresh("_rb", df)
    spread = keys.withColumn(b, F.explode(F.sequence(floor_div(lo, bucket), floor_div(hi - 1, bucket))))
    inside = spread.join(df.withColumn(rb, floor_div(ticks(df, time), bucket)), (F.col(b) == F.col(rb)) & (t >= F.col("w_open")) & (t < F.col("w_close")))
    found = inside.groupBy("w_open", "w_close").agg(*aggregates)
    return windows.join(found, ["w_open", "w_close"], "left")


def sliding(time: str, length: float, df: DataFrame, *partition: str) -> Window:
    """The frame [t - length, t], both ends in, of each row, as a Window specification over ticks."""
    return Window.partitionBy(*partition).orderBy(ticks(df, time)).rangeBetween(-span(df, time, length), 0)


def frames(df: DataFrame, boundary: Column, order: list[str], partition: list[str], name: str = "frame") -> DataFrame:
    """df and the number of its frame: a row for which boundary holds opens a new one; frames part the stream."""
    w = Window.partitionBy(*partition).orderBy(*order)
    edge = fresh("_edge", df)
    return df.withColumn(edge, F.coalesce(boundary, F.lit(False)).cast("int")).withColumn(name, F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(edge)


def delta_frames(df: DataFrame, value: str, delta: float, order: list[str], partition: list[str], name: str = "frame") -> DataFrame:
    """A row that differs from the row before by more than delta opens a new frame."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return frames(df, F.abs(F.col(value) - F.lag(value).over(w)) > delta, order, partition, name)


def session_frames(df: DataFrame, time: str, gap: float, order: list[str], partition: list[str], name: str = "frame") -> DataFrame:
    """A row more than gap after the row before opens a new frame."""
    w = Window.partitionBy(*partition).orderBy(*order)
    t = ticks(df, time)
    return frames(df, t - F.lag(t).over(w) > span(df, time, gap), order, partition, name)


def count_frames(df: DataFrame, n: int, order: list[str], partition: list[str], name: str = "frame") -> DataFrame:
    """Frames of n rows each."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(name, floor_div(F.row_number().over(w).cast("long") - 1, n))


def stateful_frames(df: DataFrame, create: Callable[[], object], update: Callable[[object, dict], object], ready: Callable[[object], bool], order: list[str], partition: list[str], name: str = "frame") -> DataFrame:
    """Frames by any state: create() makes it, update(state, row) folds a row (a dict) in, and where ready(state) holds the frame
    closes and the row opens the next one, with a state of its own. A partition's rows are folded in order as they stream
    by in one task, so that only the state is held."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, frame = object(), None, 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                key = tuple(row[c] for c in partition)
                if key != now:
                    now, state, frame = key, create(), 0
                state = update(state, row)
                if ready(state):
                    frame, state = frame + 1, update(create(), row)
                out.append(frame)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*b.schema.names, name])

    dealt = df.repartition(*partition).sortWithinPartitions(*partition, *order)
    return dealt.mapInArrow(fold, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))
