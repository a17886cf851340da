"""Declarative continuous queries, a registry of them, and views.

A query is: streams to relations (a function for each input), relations to a relation, and the relation to a stream. The
same query runs on tables and on streams, as every step is a DataFrame function. A program routes outputs and knows its
queries by name; a view answers for any instant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from tideframe.operators.relational import at

Step = Callable[[DataFrame], DataFrame]


@dataclass
class ContinuousQuery:
    """name; inputs: stream name to the window step for it; relate: the windowed relations, by stream name, to one;
    emit: what goes out of it."""

    name: str
    inputs: dict[str, Step]
    relate: Callable[[dict[str, DataFrame]], DataFrame]
    emit: Step = field(default=lambda df: df)

    def plan(self, streams: dict[str, DataFrame]) -> DataFrame:
        missing = self.inputs.keys() - streams.keys()
        if missing:
            raise KeyError(f"{self.name} lacks the streams {sorted(missing)}")
        return self.emit(self.relate({n: step(streams[n]) for n, step in self.inputs.items()}))


@dataclass
class View:
    """A query's relation at an instant: its inputs are the events up to then."""

    query: ContinuousQuery
    streams: dict[str, DataFrame]
    times: dict[str, str]

    def at(self, instant: Column) -> DataFrame:
        return self.query.plan({n: at(df, self.times[n], instant) for n, df in self.streams.items()})


class Program:
    """Queries by name, their plans over shared streams, and the streaming queries that they were started as."""

    def __init__(self) -> None:
        self.streams: dict[str, DataFrame] = {}
        self.queries: dict[str, ContinuousQuery] = {}
        self.running: dict[str, list[StreamingQuery]] = {}
        self.outputs: dict[str, str] = {}

    def add_stream(self, name: str, df: DataFrame) -> None:
        if name in self.streams:
            raise ValueError(f"there is a stream {name}")
        self.streams[name] = df

    def register(self, query: ContinuousQuery, output: str | None = None) -> DataFrame:
        """The query's result, which further queries may read as the stream `output`."""
        if query.name in self.queries:
            raise ValueError(f"there is a query {query.name}")
        result = query.plan(self.streams)
        if output:
            self.add_stream(output, result)
            self.outputs[query.name] = output
        self.queries[query.name] = query
        return result

    def view(self, query: ContinuousQuery, times: dict[str, str]) -> View:
        if query.name in self.queries:
            raise ValueError(f"there is a query {query.name}")
        self.queries[query.name] = query
        return View(query, {n: self.streams[n] for n in query.inputs}, times)

    def start(self, name: str, checkpoint: str, sinks: list[Callable[[DataFrame, int], None]], mode: str = "append", **trigger: object) -> StreamingQuery:
        """Run a registered query over streams; each micro-batch goes to every sink."""

        def to_all(batch: DataFrame, epoch: int) -> None:
            held = batch.persist() if len(sinks) > 1 else batch
            for sink in sinks:
                sink(held, epoch)
            if len(sinks) > 1:
                held.unpersist()

        out = self.queries[name].plan(self.streams).writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
        started = out.foreachBatch(to_all).trigger(**trigger or {"availableNow": True}).start()
        self.running.setdefault(name, []).append(started)
        return started

    def unregister(self, name: str) -> None:
        """Stops and forgets a query and the stream of its results; an unknown name is no error."""
        for q in self.running.pop(name, []):
            q.stop()
        self.queries.pop(name, None)
        self.streams.pop(self.outputs.pop(name, None), None)
