"""Interval joins whose bounds adapt to each key's arrivals.

A left event at t looks for right events in [t - beta, t + alpha], a right one for left events in [t - alpha, t + beta].
Bounds start at (alpha0, beta0) and belong to the key.

expand: an arrival that finds nothing widens both bounds by one step (up to their maxima) and looks again; bounds never
shrink. The first arrival of a key widens too, even if nothing came from the other side yet.
expand_shrink: an arrival widens until it finds something or both bounds are at their maxima, then narrows while it finds
more than one event (down to the start, never to none), and emits all that is left.

With a lateness, a key's watermark is its largest time less that; an event strictly behind it is late and joins nothing, and
buffers forget what no later event can reach. Without one, nothing is late and nothing is forgotten.

The outcome depends on the order of arrival, so a key's events are folded in the order of _seq, in one task; the fold looks
events up by bisection. Fold is what batch and streaming forms share.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import events_of, folded_stream, folded_table


@dataclass(frozen=True)
class Bounds:
    alpha0: int
    beta0: int
    delta: int
    alpha_max: int
    beta_max: int
    mode: str = "expand"

    def __post_init__(self) -> None:
        if self.delta <= 0:
            raise ValueError("delta must be positive")
        if not 0 <= self.alpha0 <= self.alpha_max or not 0 <= self.beta0 <= self.beta_max:
            raise ValueError("starting bounds must lie between 0 and their maxima")
        if self.mode not in ("expand", "expand_shrink"):
            raise ValueError(self.mode)


@dataclass
class Fold:
    """State of one key."""

    bounds: Bounds
    alpha: int = -1
    beta: int = -1
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    lateness: int | None = None
    top: int | None = None

    def __post_init__(self) -> None:
        if self.alpha < 0:
            self.alpha, self.beta = self.bounds.alpha0, self.bounds.beta0

    def reach(self, side: str, t: int, alpha: int, beta: int) -> tuple[int, int]:
        """Range of places in the other side's buffer."""
        low, high, other = (t - beta, t + alpha, self.right) if side == "L" else (t - alpha, t + beta, self.left)
        return bisect_left(other, (low,)), bisect_right(other, (high, chr(0x10FFFF)))

    def is_late(self, t: int) -> bool:
        """Whether t is behind the watermark, which t moves on if not."""
        if self.lateness is None or self.top is not None and t <= self.top:
            return self.lateness is not None and t < self.top - self.lateness
        self.top = t
        self.forget(t - self.lateness)
        return False

    def add(self, side: str, t: int, event: str) -> tuple[list[tuple[int, str]], tuple[int, int] | None]:
        """Take an event in; its matches (time, event) and, if the bounds changed, the ones before."""
        b, before = self.bounds, (self.alpha, self.beta)
        insort(self.left if side == "L" else self.right, (t, event))
        found = lambda: self.reach(side, t, self.alpha, self.beta)
        low, high = found()
        if b.mode == "expand":
            if low == high:
                self.widen()
                low, high = found()
        else:
            while low == high and (self.alpha, self.beta) != (b.alpha_max, b.beta_max):
                self.widen()
                low, high = found()
            while high - low > 1 and (self.alpha, self.beta) != (b.alpha0, b.beta0):
                alpha, beta = max(self.alpha - b.delta, b.alpha0), max(self.beta - b.delta, b.beta0)
                low2, high2 = self.reach(side, t, alpha, beta)
                if low2 == high2:
                    break
                self.alpha, self.beta, low, high = alpha, beta, low2, high2
        other = self.right if side == "L" else self.left
        return other[low:high], before if before != (self.alpha, self.beta) else None

    def take(self, side: str, t: int, event: str) -> list[tuple]:
        """Rows of RESULT of an arrival: pairs, adaptations of the bounds, or a late event."""
        return folded(self, [(side, t, event)])

    def widen(self) -> None:
        b = self.bounds
        self.alpha, self.beta = min(self.alpha + b.delta, b.alpha_max), min(self.beta + b.delta, b.beta_max)

    def forget(self, watermark: int) -> None:
        """Drop events that no event at or after the watermark can reach any more, at the widest bounds."""
        b = self.bounds
        del self.left[: bisect_left(self.left, (watermark - max(b.beta_max, b.alpha_max),))]
        del self.right[: bisect_left(self.right, (watermark - max(b.beta_max, b.alpha_max),))]


RESULT = "kind string, left_id string, right_id string, out_t long, side string, t long, old_alpha long, old_beta long, new_alpha long, new_beta long"


def folded(fold: Fold, rows: list[tuple[str, int, str]]) -> list[tuple]:
    """Rows of RESULT of (side, t, event) rows in order: pairs, adaptations of the bounds, and late events."""
    out = []
    for side, t, event in rows:
        if fold.is_late(t):
            out.append(("late", event if side == "L" else None, event if side == "R" else None, None, side, t, None, None, None, None))
            continue
        matches, before = fold.add(side, t, event)
        if before:
            out.append(("adapted", None, None, None, side, t, *before, fold.alpha, fold.beta))
        for t2, other in matches:
            pair = (event, other) if side == "L" else (other, event)
            out.append(("pair", *pair, max(t, t2), side, t, None, None, None, None))
    return out


def adaptive_join(events: DataFrame, bounds: Bounds, key: str = "key", side: str = "side", time: str = "t", event: str = "event", seq: str = "_seq", lateness: int | None = None) -> DataFrame:
    """key and RESULT of a stream of both sides' events (side L or R, time in ticks, event id).

    Defined results: rows with a null key, side, time or event are left out; equal _seq go by side, time and event.
    """
    return folded_table(events_of(events, key, side, time, event, seq), lambda: Fold(bounds, lateness=lateness), RESULT)


def pairs(result: DataFrame) -> DataFrame:
    return result.where("kind = 'pair'").select("key", "left_id", "right_id", "out_t")


def adaptations(result: DataFrame) -> DataFrame:
    return result.where("kind = 'adapted'").select("key", "side", "t", "old_alpha", "old_beta", "new_alpha", "new_beta")


def late(result: DataFrame) -> DataFrame:
    return result.where("kind = 'late'").select("key", "side", "t", F.coalesce("left_id", "right_id").alias("event"))


def adaptive_stream(events: DataFrame, bounds: Bounds, key: str = "key", side: str = "side", time: str = "t", event: str = "event", seq: str = "_seq", lateness: int | None = None) -> DataFrame:
    """The same over a stream: state by key, the rows of a micro-batch in the order of _seq. With a lateness, state is bounded by
    the events that lie within the lateness and the widest bounds."""
    return folded_stream(events_of(events, key, side, time, event, seq), lambda: Fold(bounds, lateness=lateness), RESULT)
