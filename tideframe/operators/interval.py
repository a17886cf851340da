"""Interval joins in batch form.

A pair matches if the right time lies in [left time + lower, left time + upper]. Both sides are put into time buckets as
wide as the interval, so a join always has an equality on the bucket (and the keys, where there are any): a hot key spreads
over its buckets, and a join without keys is no cross product.

Defined results: rows with a null key or time match nothing; null bounds aren't allowed; an inverted interval raises, and so do
sides that share names where both are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.functions.timeutil import floor_div, fresh, from_ticks, span, ticks


def bounds(df: DataFrame, time: str, lower: float, upper: float, lower_inclusive: bool = True, upper_inclusive: bool = True) -> tuple[int, int]:
    """Inclusive bounds in ticks; an exclusive one moves by a tick."""
    lo, hi = span(df, time, lower) + (not lower_inclusive), span(df, time, upper) - (not upper_inclusive)
    if lo > hi:
        raise ValueError(f"lower bound {lower} is over upper bound {upper}")
    return lo, hi


def refuse_shared_names(left: DataFrame, right: DataFrame) -> None:
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if shared:
        raise ValueError(f"both sides have the columns {sorted(shared)}")


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, lower: float, upper: float, keys: list[tuple[str, str]] = (), how: str = "inner", condition: Column | None = None, lower_inclusive: bool = True, upper_inclusive: bool = True) -> DataFrame:
    """left and right columns of matching pairs; how: inner, left, left_semi or left_anti.

    A left row lies in one bucket, and a right row is put into the one or two buckets whose left rows it can match, so each
    pair meets once, and all that a left row can match meets it in its bucket; hence outer forms need no second step.
    """
    refuse_shared_names(left, right)
    lo, hi = bounds(left, left_time, lower, upper, lower_inclusive, upper_inclusive)
    width = max(1, hi - lo)
    lt, lb, rt, rb = (fresh(n, left, right) for n in ("_lt", "_lb", "_rt", "_rb"))
    t = F.col(rt)
    l = left.withColumn(lt, ticks(left, left_time)).withColumn(lb, floor_div(F.col(lt), width))  # noqa: E741
    r = right.withColumn(rt, ticks(right, right_time)).withColumn(rb, F.explode(F.sequence(floor_div(t - hi, width), floor_div(t - lo, width))))
    on = (F.col(lb) == F.col(rb)) & t.between(F.col(lt) + lo, F.col(lt) + hi)
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    if condition is not None:
        on &= condition
    return l.join(r, on, how).drop(lt, lb, rt, rb)


def first_match(pairs: DataFrame, left_id: list[str], order: list[Column]) -> DataFrame:
    """Of each left row's pairs the first in an order."""
    n = fresh("_n", pairs)
    return pairs.withColumn(n, F.row_number().over(Window.partitionBy(*left_id).orderBy(*order))).where(F.col(n) == 1).drop(n)


def first_build(probe: DataFrame, build: DataFrame, probe_time: str, build_time: str, grace: float, keys: list[tuple[str, str]], how: str, build_order: list[str]) -> DataFrame:
    """Each probe with the first build of its key that comes before its deadline: as a key's first build of all is that of
    every probe whose deadline is later, one build a key is joined, however many there are."""
    refuse_shared_names(probe, build)
    first = first_match(build.where(F.col(build_time).isNotNull()), [y for _, y in keys], [F.col(build_time), *[F.col(c) for c in build_order]])
    on = ticks(build, build_time) < ticks(probe, probe_time) + span(probe, probe_time, grace)
    for x, y in keys:
        on &= F.col(x) == F.col(y)
    return probe.join(first, on, how)


def dynamic_join(probe: DataFrame, build: DataFrame, probe_time: str, build_time: str, grace: float, keys: list[tuple[str, str]], mode: str = "batch", lookback: float | None = None, first: bool = False, probe_id: list[str] = (), build_order: list[str] = ()) -> DataFrame:
    """A probe waits up to grace for builds and looks back over lookback (None: over all). Without a bound every pair of a key
    before the deadline is a result, unless only the first is asked for, which takes one build of each key.

    mode batch keeps probes without a match (left outer), incremental reports matches only. With first, a probe takes the
    build of least time only. Matches are allowed before the deadline, at it no more. A probe never matches itself.
    """
    how = "left" if mode == "batch" else "inner"
    if lookback is not None:
        out = interval_join(probe, build, probe_time, build_time, -lookback, grace, keys, how, upper_inclusive=False)
    elif not keys:
        raise ValueError("a join without keys needs a look-back")
    elif first:
        return first_build(probe, build, probe_time, build_time, grace, keys, how, list(build_order))
    else:
        refuse_shared_names(probe, build)
        on = ticks(build, build_time) < ticks(probe, probe_time) + span(probe, probe_time, grace)
        for x, y in keys:
            on &= F.col(x) == F.col(y)
        out = probe.join(build, on, how)
    if first:
        out = first_match(out, list(probe_id), [F.col(build_time).asc_nulls_last(), *[F.col(c) for c in build_order]])
    return out


def window_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, size: float, slide: float | None = None, keys: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs that share a key and a window [w, w + size), w a multiple of slide (tumbling: slide = size); a pair comes once
    for each window that holds both. Columns of both sides, w_start and w_end."""
    refuse_shared_names(left, right)
    size_t, slide_t = span(left, left_time, size), span(left, left_time, slide or size)
    wl, wr = fresh("_wl", left, right), fresh("_wr", left, right)

    def placed(df: DataFrame, time: str, name: str) -> DataFrame:
        t = ticks(df, time)
        last = floor_div(t, slide_t)
        first = floor_div(t - size_t, slide_t) + 1
        return df.withColumn(name, F.explode(F.when(first <= last, F.sequence(first, last))))

    on = F.col(wl) == F.col(wr)
    for a, b in keys:
        on &= F.col(a) == F.col(b)
    out = placed(left, left_time, wl).join(placed(right, right_time, wr), on)
    start = F.col(wl) * slide_t
    return out.withColumn("w_start", from_ticks(left, left_time, start)).withColumn("w_end", from_ticks(left, left_time, start + size_t)).drop(wl, wr)


def with_lateness(df: DataFrame, time: str, seq: str, delay: float, side: Column | None = None) -> DataFrame:
    """df, _watermark (largest time that arrived before, less delay; null at first) and _tag: on-time, or side-late where
    the time is strictly below the watermark.

    The running maximum over arrivals is one clock for the whole stream. It is worked out in two steps: a maximum for each
    chunk of arrivals, then within the chunks, so that only a row for each chunk is ever in one task.
    """
    t, chunk, c, top, before, inside = (fresh(n, df) for n in ("_t", "_chunk", "_c", "_top", "_before", "_within"))
    rows = df.withColumn(t, ticks(df, time)).withColumn(chunk, chunks(df, F.col(seq).cast("decimal(38,6)")))
    tops = rows.groupBy(F.col(chunk).alias(c)).agg(F.max(t).alias(top))
    earlier = tops.select(c, F.max(top).over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    within = F.max(t).over(Window.partitionBy(chunk).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn(inside, within).join(earlier, F.col(chunk).eqNullSafe(F.col(c)))
    mark = F.greatest(inside, before) - span(df, time, delay)
    late = F.col(t) < mark
    tag = F.when(late, F.concat(side, F.lit("-late")) if side is not None else F.lit("late")).otherwise(F.lit("on-time"))
    return out.withColumn("_tag", tag).withColumn("_watermark", from_ticks(df, time, mark)).drop(t, chunk, c, before, inside)


CHUNK_ROWS = 100_000


def chunks(df: DataFrame, value: Column, rows: int = CHUNK_ROWS) -> Column:
    """A number that grows with the value, of about `rows` rows each where values are spread evenly."""
    known = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    step = F.greatest((F.col("high") - F.col("low")) * rows / F.greatest(F.col("n"), F.lit(1)), F.lit(1).cast("decimal(38,6)"))
    scale = known.select(F.struct(F.col("low").alias("low"), step.alias("step"))).scalar()
    return F.floor((value - scale["low"]) / scale["step"]).cast("long")
