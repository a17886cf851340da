"""Folds: a key's events, in the order of arrival, through a state of their own. One form for tables and one for streams.

A fold has take(side, t, event), which gives result rows as tuples. Rows with a null key, side, time or event are left out; equal
_seq go by side, time and event.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fold(Protocol):
    def take(self, side: str, t: int, event: str) -> list[tuple]: ...


def fields(schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and types of a schema of longs and strings."""
    return [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in schema.split(", ")]


def events_of(events: DataFrame, key: str, side: str, time: str, event: str, seq: str) -> DataFrame:
    return events.select(F.col(key).alias("key"), F.col(side).alias("side"), F.col(time).cast("long").alias("t"), F.col(event).cast("string").alias("event"), F.col(seq).alias("seq")).dropna()


def folded_table(events: DataFrame, make: Callable[[], Fold], schema: str) -> DataFrame:
    """key and the result rows. Events come sorted by key and order, so that a key is folded as it streams by; only its state is
    held."""
    kind, names = events.schema["key"].dataType.simpleString(), fields(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, keys, out = object(), None, [], []
        for b in batches:
            for k, side, t, e in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                if k != now:
                    now, state = k, make()
                found = state.take(side, t, e)
                keys += [k] * len(found)
                out += found
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *(pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), names, strict=True))], names=["key", *[n for n, _ in names]])
                keys, out = [], []

    return events.repartition("key").sortWithinPartitions("key", "seq", "side", "t", "event").mapInArrow(fold, f"key {kind}, {schema}")


def folded_stream(events: DataFrame, make: Callable[[], Fold], schema: str) -> DataFrame:
    """The same over a stream: state by key, the events of a micro-batch in order."""
    import pandas as pd

    kind, names = events.schema["key"].dataType.simpleString(), fields(schema)

    def step(key: tuple, frames: object, state: object) -> object:
        fold = pickle.loads(state.get[0]) if state.exists else make()
        pdf = pd.concat(list(frames)).sort_values(["seq", "side", "t", "event"])
        out = [row for e in pdf[["side", "t", "event"]].itertuples(index=False, name=None) for row in fold.take(*e)]
        state.update((pickle.dumps(fold),))
        found = pd.DataFrame(out, columns=[n for n, _ in names]).astype({n: "Int64" for n, t in names if t == pa.int64()})
        found.insert(0, "key", key[0])
        yield found

    return events.groupBy("key").applyInPandasWithState(step, f"key {kind}, {schema}", "fold binary", "append", "NoTimeout")
