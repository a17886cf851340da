"""Relation-to-relation and relation-to-stream steps beyond what DataFrame has itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rstream(snapshot: DataFrame) -> DataFrame:
    """All rows of the relation at an instant."""
    return snapshot


def istream(snapshot: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that came since the instant before, with their number."""
    return snapshot.exceptAll(before)


def dstream(snapshot: DataFrame, before: DataFrame) -> DataFrame:
    """Rows that went since the instant before."""
    return before.exceptAll(snapshot)


def changes(snapshots: DataFrame, instant: str, instants: DataFrame, step: Column) -> DataFrame:
    """The incremental streams of a relation at a series of instants: its rows that came (change +1, an insert) and went (-1, a
    delete) since the instant before, as often as they did, at the instant. snapshots has a row of each instant for each row of
    the relation then, instants all instants (a row each, one column of that name) and step what to add to one for the next.
    At the first instant all rows came."""
    columns = [c for c in snapshots.columns if c != instant]
    counted = snapshots.groupBy(*snapshots.columns).agg(F.count("*").alias("_n"))
    after = counted.withColumn(instant, F.col(instant) + step).join(instants, instant, "left_semi").withColumn("_n", -F.col("_n"))
    both = counted.unionByName(after).groupBy(*snapshots.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return both.select(instant, *columns, F.signum("_n").cast("int").alias("change"), F.explode(F.sequence(F.lit(1), F.abs(F.col("_n")).cast("int"))).alias("_i")).drop("_i")


def closure(hierarchy: DataFrame, most: int = 32) -> DataFrame:
    """The transitive closure of (sub, super), by doubling the length of paths; a longer chain than 2^most raises."""
    known = hierarchy.select("sub", "super").distinct()
    size = known.count()
    for _ in range(most):
        more = known.alias("a").join(known.alias("b"), F.col("a.super") == F.col("b.sub")).select("a.sub", "b.super")
        known = known.union(more).distinct().checkpoint() if known.sparkSession.sparkContext.getCheckpointDir() else known.union(more).distinct()
        if known.count() == size:
            return known
        size = known.count()
    raise ValueError("the hierarchy is too deep")


def at(df: DataFrame, time: str, instant: Column) -> DataFrame:
    """The relation of all events up to an instant."""
    return df.where(F.col(time) <= instant)


def triple_pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Bindings of a pattern over columns s, p, o; terms that begin with ? are variables and name the result's columns."""
    terms = {"s": s, "p": p, "o": o}
    out = reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in terms.items() if not v.startswith("?")), triples)
    names: dict[str, str] = {}
    for k, v in terms.items():
        if v.startswith("?") and v[1:] in names:  # a variable that comes twice
            out = out.where(F.col(k) == F.col(names[v[1:]]))
        elif v.startswith("?"):
            names[v[1:]] = k
    return out.select(*[F.col(k).alias(v) for v, k in names.items()])


def basic_graph_pattern(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Patterns joined on the variables they share; patterns that share none must be joined by the caller."""
    out = triple_pattern(triples, *patterns[0])
    for pattern in patterns[1:]:
        more = triple_pattern(triples, *pattern)
        shared = [c for c in more.columns if c in out.columns]
        if not shared:
            raise ValueError(f"{pattern} shares no variable with the patterns before it")
        out = out.join(more, shared)
    return out


def upward(triples: DataFrame, hierarchy: DataFrame, type_predicate: str = "rdf:type") -> DataFrame:
    """triples and, for each type triple, one for each superclass in hierarchy (sub, super; transitively closed)."""
    typed = triples.where(F.col("p") == type_predicate)
    more = typed.join(hierarchy, F.col("o") == F.col("sub")).select("s", "p", F.col("super").alias("o"), *[c for c in triples.columns if c not in "spo"])
    return triples.unionByName(more).distinct()


def validated_stream(rows: DataFrame, key: str, order_time: str, shipment_time: str) -> DataFrame:
    """Of each key the first order with each of its shipments."""
    first = rows.groupBy(F.col(key).alias("_k")).agg(F.min(order_time).alias("_first"))
    return rows.join(first, (F.col(key) == F.col("_k")) & (F.col(order_time) == F.col("_first"))).drop("_k", "_first").withColumn("out_ts", F.greatest(order_time, shipment_time))
