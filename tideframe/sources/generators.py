"""Test data: orders and payments whose pairs are known, out of order on arrival, and ground truth for three streams.

Rows come from spark.range and hashes of a seed, so any scale is generated in parallel and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideframe.functions.timeutil import floor_div
from tideframe.operators.elastic import Streams, elastic_validation

# Shares of orders (of 110) and the range of (payment time - order time) of each kind, for bounds alpha 30..90, beta 10..70.
KINDS = {"NORMAL": (30, -8, 28), "LATE": (20, 35, 88), "VERY_LATE": (15, 100, 150), "EARLY": (15, -68, -11), "DUPLICATE": (20, -8, 28), "NO_PAYMENT": (10, 0, 0)}
SPACING = 20


def chance(seed: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / F.lit(1 << 30)


def between(seed: int, low: Column, high: Column, *parts: Column) -> Column:
    return (low + F.floor(chance(seed, *parts) * (high - low + 1))).cast("long")


def two_streams(spark: SparkSession, scale: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders (orderId, tO), payments (paymentId, orderId, tP, status) and truth (orderId, correctPaymentId, category)."""
    place, upto, kind, low, high = F.col("id") % 110, 0, F.lit(None).cast("string"), F.lit(0), F.lit(0)
    for name, (share, a, b) in KINDS.items():
        inside = (place >= upto) & (place < upto + share)
        kind, low, high = F.when(inside, name).otherwise(kind), F.when(inside, a).otherwise(low), F.when(inside, b).otherwise(high)
        upto += share
    base = spark.range(110 * scale).withColumn("category", kind).withColumn("low", low).withColumn("high", high)
    base = base.withColumn("orderId", F.format_string("O%09d", "id")).withColumn("tO", F.col("id") * SPACING + F.floor(F.col("id") / 110) * 500 + 200)
    base = base.withColumn("tP", F.when(F.col("category") != "NO_PAYMENT", F.col("tO") + between(seed, F.col("low"), F.col("high"), F.col("id"))))
    orders = base.select("orderId", "tO")
    good = base.where("tP is not null").select(F.concat(F.lit("P"), F.substring("orderId", 2, 9)).alias("paymentId"), "orderId", "tP", F.lit("VALID").alias("status"))
    twice = base.where("category = 'DUPLICATE'").select(F.concat(F.lit("D"), F.substring("orderId", 2, 9)).alias("paymentId"), "orderId", (F.col("tP") + between(seed + 1, F.lit(1), F.lit(28), F.col("id"))).alias("tP"), F.lit("DUPLICATE").alias("status"))
    failed = base.where(F.col("tP").isNotNull() & (chance(seed + 2, F.col("id")) < 0.5)).select(F.concat(F.lit("F"), F.substring("orderId", 2, 9)).alias("paymentId"), "orderId", (F.col("tP") + between(seed + 3, F.lit(-5), F.lit(5), F.col("id"))).alias("tP"), F.lit("FAILED").alias("status"))
    truth = base.select("orderId", F.when(F.col("tP").isNotNull(), F.concat(F.lit("P"), F.substring("orderId", 2, 9))).alias("correctPaymentId"), "category")
    return orders, good.unionByName(twice).unionByName(failed), truth


def arrivals(orders: DataFrame, payments: DataFrame, seed: int = 42, swapped: float = 0.2, chunk: int = 100_000) -> DataFrame:
    """Both sides as (key, side, t, event, _seq): in time order, but for some pairs of neighbours that change places. Rows are
    numbered within chunks of time, so that no task holds all; pairs don't cross them."""
    both = orders.select(F.col("orderId").alias("key"), F.lit("L").alias("side"), F.col("tO").alias("t"), F.col("orderId").alias("event"))
    both = both.unionByName(payments.select(F.col("orderId").alias("key"), F.lit("R").alias("side"), F.col("tP").alias("t"), F.col("paymentId").alias("event")))
    part = floor_div(F.col("t"), chunk)
    numbered = both.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("t", "event")).cast("long"))
    # runs of places that follow a swap are skipped by pairing places two by two
    pair, second = F.shiftright("place", 1), F.col("place").bitwiseAND(1)
    swap = chance(seed + 4, F.col("part"), pair) < swapped
    moved = F.when(swap, F.lit(1) - second).otherwise(second)
    return numbered.withColumn("_seq", F.shiftleft("part", 32) + 2 * pair + moved).drop("part", "place")


#: Orders of each category (of 72), and the ranges of (time - order time) of payments and of shipments, for U 100, V 50, G 30.
CATEGORIES = {
    "NORMAL": (20, [(5, 50)], [(55, 100)]),
    "LATE_PAYMENT": (10, [(51, 80)], [(81, 100)]),
    "LATE_SHIPMENT": (8, [(5, 50)], [(91, 100)]),
    "DUPLICATE_PAYMENT": (10, [(5, 40), (41, 80)], [(60, 100)]),
    "MULTIPLE_SHIPMENTS": (8, [(5, 50)], [(20, 60), (61, 100)]),
    "COMPLEX": (6, [(5, 30), (31, 80)], [(20, 60), (61, 100)]),
    "NO_SHIPMENT": (5, [(5, 50)], []),
    "NO_PAYMENT": (5, [], [(20, 100)]),
}


def case_streams(spark: SparkSession, scale: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """orders, payments, shipments (of the fixture schemas) and truth (orderId, category), 72 orders a chunk. A failed payment
    goes before each third of the first ones."""
    kinds = [(name, pays, ships) for name, (n, pays, ships) in CATEGORIES.items() for _ in range(n)]
    cases = spark.createDataFrame([(i, name, pays, ships) for i, (name, pays, ships) in enumerate(kinds)], "place int, category string, pays array<struct<low:long,high:long>>, ships array<struct<low:long,high:long>>")
    base = spark.range(len(kinds) * scale).join(F.broadcast(cases), F.col("id") % len(kinds) == F.col("place"))
    base = base.withColumn("orderId", F.format_string("O%09d", "id")).withColumn("tO", F.col("id") * 10)
    amount = F.round(50 + 450 * chance(seed, F.col("id")), 2)

    def placed(what: str, salt: int) -> DataFrame:
        at = base.select("id", "orderId", "tO", F.posexplode(what).alias("nth", "range"))
        return at.withColumn("t", F.col("tO") + between(seed + salt, F.col("range.low"), F.col("range.high"), F.col("id"), F.col("nth")))

    pays, ships = placed("pays", 1), placed("ships", 2)
    paid = pays.select(F.format_string("P%09d%d", "id", "nth").alias("paymentId"), "orderId", F.lit("PAID").alias("status"), amount.alias("amount"), "t")
    failed = pays.where("nth = 0 and id % 3 = 0").select(F.format_string("F%09d", "id").alias("paymentId"), "orderId", F.lit("FAILED").alias("status"), amount.alias("amount"), (F.col("t") - 1).alias("t"))
    carrier = F.element_at(F.array(F.lit("FedEx"), F.lit("UPS"), F.lit("DHL")), (F.floor(chance(seed + 3, F.col("id"), F.col("nth")) * 3) + 1).cast("int"))
    shipments = ships.select(F.format_string("S%09d%d", "id", "nth").alias("shipmentId"), "orderId", carrier.alias("carrier"), "t")
    orders = base.select("orderId", F.format_string("C%09d", "id").alias("customerId"), amount.alias("amount"), F.col("tO").alias("t"))
    return orders, paid.unionByName(failed), shipments, base.select("orderId", "category")


@dataclass(frozen=True)
class Anomalies:
    """Chances of what may go wrong with an order."""

    missing_payment: float = 0.1
    failed_payment: float = 0.1
    late_payment: float = 0.1
    duplicate_payment: float = 0.15
    early_payment: float = 0.1
    missing_shipment: float = 0.1
    late_shipment: float = 0.1
    second_shipment: float = 0.2


def integrity_streams(spark: SparkSession, n: int, u: int = 100, v: int = 50, g: int = 30, gap: int = 10, p: Anomalies = Anomalies(), seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """orders, payments and shipments of the fixture schemas with random anomalies: payments that lack, fail, come late, twice or
    before their order, and shipments that lack, come late or twice."""
    i = F.col("id")
    happens = lambda k, share: chance(seed + k, i) < share
    base = spark.range(1, n + 1).withColumn("orderId", F.concat(F.lit("O"), i)).withColumn("tO", (i - 1) * gap)
    late = lambda k, share, span: F.when(happens(k, share), F.col("tO") + span + between(seed + k + 50, F.lit(1), F.lit(span), i)).otherwise(F.col("tO") + between(seed + k + 60, F.lit(0), F.lit(span), i))
    rows = base.withColumn("pt", late(1, p.late_payment, v + g)).withColumn("st", late(2, p.late_shipment, u))
    amount, status = F.round(50 + 500 * chance(seed, i), 2), F.when(happens(3, p.failed_payment), "FAILED").otherwise("PAID")
    pay = lambda df, name, state, t: df.select(F.concat(F.lit(name), i).alias("paymentId"), "orderId", state.alias("status"), amount.alias("amount"), t.alias("t"))
    payers = rows.where(~happens(4, p.missing_payment))
    twice, before = payers.where(happens(5, p.duplicate_payment)), payers.where(happens(6, p.early_payment))
    payments = pay(payers, "P", status, F.col("pt")).unionByName(pay(twice, "D", status, F.col("pt") + between(seed + 7, F.lit(1), F.lit(v + g), i)))
    payments = payments.unionByName(pay(before, "E", F.lit("PAID"), F.greatest(F.lit(0), F.col("tO") - between(seed + 8, F.lit(1), F.lit(20), i))))
    carrier = F.element_at(F.array(F.lit("DHL"), F.lit("UPS"), F.lit("FedEx")), (F.floor(chance(seed + 9, i) * 3) + 1).cast("int"))
    send = lambda df, name, t: df.select(F.concat(F.lit(name), i).alias("shipmentId"), "orderId", carrier.alias("carrier"), t.alias("t"))
    sent = rows.where(~happens(10, p.missing_shipment))
    shipments = send(sent, "S", F.col("st")).unionByName(send(sent.where(happens(11, p.second_shipment)), "T", F.col("st") + between(seed + 12, F.lit(1), F.lit(u), i)))
    return rows.select("orderId", F.concat(F.lit("C"), i).alias("customerId"), amount.alias("amount"), F.col("tO").alias("t")), payments, shipments


def ground_truth(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: int, v: int, g: int) -> DataFrame:
    """orderId, paymentId, shipmentId, orderTime, paymentTime, shipmentTime of valid orders, from the fixture schemas."""
    c = Streams("orderId", "orderId", "orderTime", "p_order", "paymentId", "paymentTime", "s_order", "shipmentId", "shipmentTime")
    o = orders.select("orderId", F.col("t").alias("orderTime"))
    p = payments.select(F.col("orderId").alias("p_order"), "paymentId", "status", F.col("t").alias("paymentTime"))
    s = shipments.select(F.col("orderId").alias("s_order"), "shipmentId", F.col("t").alias("shipmentTime"))
    out = elastic_validation(o, p, s, u, v, g, F.col("status") == "PAID", c)
    return out.select("orderId", "paymentId", "shipmentId", "orderTime", "paymentTime", "shipmentTime")
