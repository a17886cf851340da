"""How well a join found what is true: counts, rates and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(found: DataFrame, truth: DataFrame, keys: list[str], latency: str | None = None, count_rows: bool = False) -> DataFrame:
    """One row: tp, fp, fn, duplicates, precision, recall, f1, dup_rate and, with a latency column of found, its mean,
    median and p95 (both interpolated). False positives count distinct keys, or rows with count_rows."""
    more = [F.min(latency).alias("_lat")] if latency else []
    distinct = found.groupBy(*keys).agg(F.count("*").alias("_n"), *more)
    marked = distinct.join(truth.select(*keys).distinct().withColumn("_true", F.lit(1)), keys, "full")
    hit, extra = F.col("_true").isNotNull() & F.col("_n").isNotNull(), F.col("_true").isNull()
    stats = [F.avg(F.when(hit, F.col("_lat"))).alias("lat_mean"), F.percentile(F.when(hit, F.col("_lat")), F.lit(0.5)).alias("lat_median"), F.percentile(F.when(hit, F.col("_lat")), F.lit(0.95)).alias("lat_p95")] if latency else []
    fp = F.sum(F.when(extra, F.col("_n")).otherwise(0)) if count_rows else F.count_if(extra)
    one = marked.agg(F.count_if(hit).alias("tp"), F.coalesce(fp, F.lit(0)).alias("fp"), F.count_if(F.col("_n").isNull()).alias("fn"), F.coalesce(F.sum(F.when(hit, F.col("_n") - 1)), F.lit(0)).alias("duplicates"), *stats)
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = one.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return one.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("dup_rate", rate(F.col("duplicates"), F.col("tp") + F.col("fn")))


def recall_by(found: DataFrame, truth: DataFrame, keys: list[str], category: str) -> DataFrame:
    """category, n (true rows), hits and recall."""
    hits = truth.join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hits.groupBy(category).agg(F.count("*").alias("n"), F.count("_hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))
