"""Event time: shifts, ticks and buckets that work on whole-number ticks and on timestamps alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_time(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType))


def ticks(df: DataFrame, column: str, unit: int = 1) -> Column:
    """The column as whole numbers: itself, or the microseconds since 1970 (session time zone UTC) of a timestamp."""
    return F.unix_micros(F.col(column).cast("timestamp")) if is_time(df, column) else F.col(column).cast("long")


def span(df: DataFrame, column: str, delta: float) -> int:
    """A delta (seconds for timestamps, ticks else) in the unit of ticks()."""
    return round(delta * 1_000_000) if is_time(df, column) else int(delta)


def from_ticks(df: DataFrame, column: str, value: Column) -> Column:
    """The inverse of ticks(), in the column's own type."""
    kind = df.schema[column].dataType
    return F.timestamp_micros(value).cast(kind) if is_time(df, column) else value.cast(kind)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has yet, whatever the case of its letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def floor_div(a: Column, b: int) -> Column:
    """Whole quotient, rounded down for negative numbers too."""
    return F.floor((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long") if b != 1 else a


def ceil_div(a: Column, b: int) -> Column:
    return -floor_div(-a, b)


def with_arrival(df: DataFrame, *order: str) -> DataFrame:
    """df and _seq, the place of arrival; it is unique if the order is."""
    from pyspark.sql import Window

    return df.withColumn("_seq", F.row_number().over(Window.orderBy(*order)).cast("long"))
