"""Sources and sinks: files as tables and as streams, generated rows, memory and file sinks. Streams have declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ORDERS = "orderId string, customerId string, amount double, t bigint"
PAYMENTS = "paymentId string, orderId string, status string, amount double, t bigint"
SHIPMENTS = "shipmentId string, orderId string, carrier string, t bigint"
TRUTH = "orderId string, paymentId string, shipmentId string, orderTime bigint, paymentTime bigint, shipmentTime bigint"


def table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet", **options: object) -> DataFrame:
    """A file table: parquet, csv, json, orc or jdbc options; csv and json need a schema."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**{"header": True} | options if kind == "csv" else options)
    return (reader.schema(schema) if schema else reader).load(path)


def stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_at_once: int = 1, **options: object) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**{"header": True} | options if kind == "csv" else options).option("maxFilesPerTrigger", files_at_once).load(path)


def rate(spark: SparkSession, rows_per_second: int) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_memory(df: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    return df.writeStream.format("memory").queryName(name).outputMode(mode).start()


def to_files(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet", mode: str = "append") -> StreamingQuery:
    return df.writeStream.format(kind).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def partitioned(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a key in one of n partitions."""
    return df.repartition(n, *keys)
