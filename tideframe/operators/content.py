"""What a window's content amounts to: aggregate specifications for groupBy(...).agg(...).

First and last go by arrival, never by partition order. Each has a value for an empty window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def accumulated(value: str, seq: str) -> Column:
    """All values of the window in order of arrival."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(value).alias("value")))), lambda x: x["value"])


def reduced(value: str, seq: str, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """The values folded in order of arrival; empty windows give zero."""
    return F.aggregate(accumulated(value, seq), zero, merge)


def filtered(aggregate: Callable[[Column], Column], value: Column, keep: Column) -> Column:
    """An aggregate of the values that keep holds for."""
    return aggregate(F.when(keep, value))


def first(value: str, seq: str) -> Column:
    return F.min_by(value, seq)


def last(value: str, seq: str) -> Column:
    return F.max_by(value, seq)


def empty(aggregate: Column, zero: Column) -> Column:
    """For windows without rows, after a left join from the grid of windows."""
    return F.coalesce(aggregate, zero)


def counted_keys(key: str) -> Column:
    """Size of a keyed content: its number of keys."""
    return F.count_distinct(key)
