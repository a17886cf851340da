"""When a window is reported: predicates on rows (w_close, eval_ts, n, ...), and ticks. A report is the conjunction of its
strategies; none means always."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(*strategies: Column) -> Column:
    return reduce(lambda a, b: a & b, strategies, F.lit(True))


def on_window_close(close: str = "w_close", now: str = "eval_ts") -> Column:
    """Strictly: a window isn't reported at its close, but after it."""
    return F.col(close) < F.col(now)


def non_empty(n: str = "n") -> Column:
    return F.col(n) > 0


def periodic(now: Column, period: int) -> Column:
    if period <= 0:
        raise ValueError("the period must be positive")
    return F.pmod(now, F.lit(period)) == 0


def on_content_change(df: DataFrame, content: str, order: list[str], partition: list[str]) -> DataFrame:
    """The rows whose content differs from that of the row before; the first row counts as a change."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.lag(F.struct(content)).over(w)
    return df.withColumn("_b", before).where(F.col("_b").isNull() | ~F.col(f"_b.{content}").eqNullSafe(F.col(content))).drop("_b")


def on_state_ready(states: DataFrame, ready: Column) -> DataFrame:
    """The states (of frames, say) for which a condition on them holds; one that is null doesn't."""
    return states.where(F.coalesce(ready, F.lit(False)))


def time_ticks(df: DataFrame, time: str) -> DataFrame:
    """A tick for each distinct time, with the number of rows at it."""
    return df.groupBy(F.col(time).alias("eval_ts")).agg(F.count("*").alias("duplicates"))


def tuple_ticks(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn("eval_ts", F.col(time))


def batch_ticks(df: DataFrame, time: str, n: int, seq: str) -> DataFrame:
    """A tick at every n-th arrival; seq counts arrivals from 1."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.where(F.pmod(F.col(seq), F.lit(n)) == 0).withColumn("eval_ts", F.col(time))
