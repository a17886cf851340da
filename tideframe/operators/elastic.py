"""Elastic joins of three streams: orders, the payments that validate them, and the shipments that they are joined with.

Times are event times; an order's payment is the earliest that counts, in [t, t + V + G], ties by `payment_order`; its
shipments are those in [t, t + U]. Both sides of each join are put into time buckets (interval.interval_join).

semantics "final" looks at all events. "arrival" looks at events in the order of _seq, and an order is final with the
shipments that had arrived when it became valid.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.functions.timeutil import span, ticks

from .folds import events_of, folded_stream, folded_table
from .interval import first_match, interval_join


@dataclass(frozen=True)
class Streams:
    """Column names of the three streams; names must differ between them."""

    order_key: str = "o_key"
    order_id: str = "o_id"
    order_time: str = "o_ts"
    payment_key: str = "p_key"
    payment_id: str = "p_id"
    payment_time: str = "p_ts"
    shipment_key: str = "s_key"
    shipment_id: str = "s_id"
    shipment_time: str = "s_ts"


def paid_orders(orders: DataFrame, payments: DataFrame, grace: float, counts: Column | None, c: Streams) -> DataFrame:
    """Orders with their payment; grace is V + G. counts: which payments count, e.g. a status."""
    valid = payments if counts is None else payments.where(counts)
    pairs = interval_join(orders, valid, c.order_time, c.payment_time, 0, grace, [(c.order_key, c.payment_key)])
    return first_match(pairs, [c.order_id], [F.col(c.payment_time), F.col(c.payment_id)])


def base_then_grace(orders: DataFrame, payments: DataFrame, v: float, g: float, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """Orders with their earliest payment in [t, t + V], else the earliest in (t + V, t + V + G], and graced, whether it was the
    latter. It is the payment of paid_orders, as all that lie in the base come before all that lie in the grace."""
    paid = paid_orders(orders, payments, v + g, counts, c)
    return paid.withColumn("graced", ticks(paid, c.payment_time) > ticks(paid, c.order_time) + span(orders, c.order_time, v))


def elastic_validation(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: float, v: float, g: float, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """A row for each valid order and each of its shipments, and out_ts, the latest of the three times."""
    paid = paid_orders(orders, payments, v + g, counts, c)
    out = interval_join(paid, shipments, c.order_time, c.shipment_time, 0, u, [(c.order_key, c.shipment_key)])
    return out.withColumn("out_ts", F.greatest(c.order_time, c.payment_time, c.shipment_time))


def elastic_status(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: float, v: float, g: float, now: Column, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """order_id, n_shipments and status of each order at a time (in ticks): VALID with a payment and shipments; INVALID
    without a payment after its deadline; NO_CONTENT with a payment but no shipment after theirs; else PENDING."""
    paid = paid_orders(orders, payments, v + g, counts, c).select(F.col(c.order_id).alias("_paid"))
    sent = interval_join(orders, shipments, c.order_time, c.shipment_time, 0, u, [(c.order_key, c.shipment_key)]).groupBy(F.col(c.order_id).alias("_sent")).agg(F.count("*").alias("n_shipments"))
    t = ticks(orders, c.order_time)
    status = (
        F.when(F.col("_paid").isNotNull() & F.col("n_shipments").isNotNull(), "VALID")
        .when(F.col("_paid").isNull() & (now > t + span(orders, c.order_time, v + g)), "INVALID")
        .when(F.col("_paid").isNotNull() & (now > t + span(orders, c.order_time, u)), "NO_CONTENT")
        .otherwise("PENDING")
    )
    joined = orders.join(paid, F.col(c.order_id) == F.col("_paid"), "left").join(sent, F.col(c.order_id) == F.col("_sent"), "left")
    return joined.withColumn("status", status).select(c.order_id, F.coalesce("n_shipments", F.lit(0)).alias("n_shipments"), "status")


def elastic_arrival(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: float, v: float, g: float, seq: tuple[str, str, str], counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """Validation by arrival: the payment is the first to arrive of those in reach, and the order becomes final at the
    first arrival by which it has both a payment and a shipment; later shipments are dropped. Columns and _final_seq."""
    os, ps, ss = seq
    valid = payments if counts is None else payments.where(counts)
    pairs = interval_join(orders, valid, c.order_time, c.payment_time, 0, v + g, [(c.order_key, c.payment_key)])
    paid = first_match(pairs, [c.order_id], [F.col(ps)])
    out = interval_join(paid, shipments, c.order_time, c.shipment_time, 0, u, [(c.order_key, c.shipment_key)])
    firsts = out.groupBy(F.col(c.order_id).alias("_f")).agg(F.min(ss).alias("_s1"))
    out = out.join(firsts, F.col(c.order_id) == F.col("_f")).withColumn("_final_seq", F.greatest(os, ps, "_s1"))
    return out.where(F.col(ss) <= F.col("_final_seq")).drop("_f", "_s1")


def elastic_windowing(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: float, v: float, g: float, mode: str = "elastic", extension: float = 0, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """Two chained interval joins; the shipment window starts at the order (fixed), at the payment (elastic), or at the
    order with an extension (extended)."""
    paid = paid_orders(orders, payments, v + g, counts, c)
    if mode not in ("fixed", "elastic", "extended"):
        raise ValueError(mode)
    anchor = c.payment_time if mode == "elastic" else c.order_time
    out = interval_join(paid, shipments, anchor, c.shipment_time, 0, u + (extension if mode == "extended" else 0), [(c.order_key, c.shipment_key)])
    return out.withColumn("out_ts", F.greatest(c.order_time, c.payment_time, c.shipment_time))


def elastic_windowing_arrival(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: float, v: float, g: float, seq: tuple[str, str, str], mode: str = "elastic", extension: float = 0, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """The same by arrival: an order takes the first payment to arrive after it that lies in [t, t + V + G], and a shipment is
    joined whenever it arrives, as both wait for each other. Columns and _final_seq, the arrival that completes the row."""
    if mode not in ("fixed", "elastic", "extended"):
        raise ValueError(mode)
    os, ps, ss = seq
    valid = payments if counts is None else payments.where(counts)
    pairs = interval_join(orders, valid, c.order_time, c.payment_time, 0, v + g, [(c.order_key, c.payment_key)], condition=F.col(ps) > F.col(os))
    paid = first_match(pairs, [c.order_id], [F.col(ps)])
    anchor = c.payment_time if mode == "elastic" else c.order_time
    out = interval_join(paid, shipments, anchor, c.shipment_time, 0, u + (extension if mode == "extended" else 0), [(c.order_key, c.shipment_key)])
    return out.withColumn("_final_seq", F.greatest(ps, ss))


def three_way(orders: DataFrame, payments: DataFrame, shipments: DataFrame, lower: float, upper: float, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """Every payment and every shipment in the interval, for each order: the classic fixed join."""
    valid = payments if counts is None else payments.where(counts)
    first = interval_join(orders, valid, c.order_time, c.payment_time, lower, upper, [(c.order_key, c.payment_key)])
    return interval_join(first, shipments, c.order_time, c.shipment_time, lower, upper, [(c.order_key, c.shipment_key)])


def validated_orders(orders: DataFrame, payments: DataFrame, v: float, strict: bool = True, counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """Orders whose key's last payment that counts lies in [t, t + v] (strict) or exists (relaxed)."""
    valid = payments if counts is None else payments.where(counts)
    last = valid.groupBy(F.col(c.payment_key).alias("_k")).agg(F.max(F.struct(c.payment_time, c.payment_id)).alias("_last"))
    last = last.select("_k", F.col(f"_last.{c.payment_time}").alias("_pt"), F.col(f"_last.{c.payment_id}").alias(c.payment_id))
    t, p = ticks(orders, c.order_time), ticks(last, "_pt")
    joined = orders.join(last, F.col(c.order_key) == F.col("_k"))
    return (joined.where(p.between(t, t + span(orders, c.order_time, v))) if strict else joined).drop("_k", "_pt")


def static_pipeline(orders: DataFrame, payments: DataFrame, shipments: DataFrame, u: float, v: float, seq: tuple[str, str, str], counts: Column | None = None, c: Streams = Streams()) -> DataFrame:
    """Only an order's arrival triggers: payment and shipment must have arrived before it, the payment in [t, t + v], the
    shipment in [t, t + u]."""
    os, ps, ss = seq
    valid = payments if counts is None else payments.where(counts)
    paid = first_match(interval_join(orders, valid, c.order_time, c.payment_time, 0, v, [(c.order_key, c.payment_key)], condition=F.col(ps) < F.col(os)), [c.order_id], [F.col(ps).desc()])
    return interval_join(paid, shipments, c.order_time, c.shipment_time, 0, u, [(c.order_key, c.shipment_key)], condition=F.col(ss) < F.col(os))


#: kind: VALID for a row of an order and a shipment; INVALID or NO_CONTENT for an order that has expired; late for an event
#: (order_id holds it).
OUTCOME = "kind string, order_id string, payment_id string, shipment_id string, order_t long"


@dataclass
class ElasticFold:
    """A key's validation by arrival (sides O, P and S), as in elastic_arrival. With a lateness, the watermark is the largest time
    less that: events behind it are late, orders whose windows it has passed expire, and events out of reach are forgotten."""

    u: int
    grace: int  # V + G
    lateness: int | None = None
    top: int | None = None
    orders: dict[str, list] = field(default_factory=dict)  # time, payment
    payments: list[tuple[int, str]] = field(default_factory=list)
    shipments: list[tuple[int, str]] = field(default_factory=list)

    def take(self, side: str, t: int, event: str) -> list[tuple]:
        out = []
        if self.lateness is not None:
            if self.top is not None and t < self.top - self.lateness:
                return [("late", event, None, None, t)]
            if self.top is None or t > self.top:
                self.top = t
                out = self.expired(t - self.lateness)
        if side == "O":
            paid = next((p for pt, p in self.payments if t <= pt <= t + self.grace), None)
            self.orders[event] = [t, paid]
            return out + self.settled(event)
        if side == "P":
            self.payments.append((t, event))
            open_ = [o for o, (ot, paid) in self.orders.items() if paid is None and ot <= t <= ot + self.grace]
            for o in open_:
                self.orders[o][1] = event
        else:
            self.shipments.append((t, event))
            open_ = [o for o, (ot, paid) in self.orders.items() if paid is not None and ot <= t <= ot + self.u]
        return out + [row for o in open_ for row in self.settled(o)]

    def settled(self, order: str) -> list[tuple]:
        """The rows of an order that has all it needs; it is final then."""
        t, paid = self.orders[order]
        sent = [s for st, s in self.shipments if t <= st <= t + self.u] if paid is not None else []
        if sent:
            del self.orders[order]
        return [("VALID", order, paid, s, t) for s in sent]

    def expired(self, mark: int) -> list[tuple]:
        reach = max(self.u, self.grace)
        self.payments = [x for x in self.payments if x[0] >= mark - reach]
        self.shipments = [x for x in self.shipments if x[0] >= mark - reach]
        over = [(o, t, paid) for o, (t, paid) in self.orders.items() if (t + self.grace < mark if paid is None else t + self.u < mark)]
        for o, _, _ in over:
            del self.orders[o]
        return [("INVALID" if paid is None else "NO_CONTENT", o, paid, None, t) for o, t, paid in over]


def elastic_fold(events: DataFrame, u: int, v: int, g: int, lateness: int | None = None, key: str = "key", side: str = "side", time: str = "t", event: str = "event", seq: str = "_seq") -> DataFrame:
    """key and OUTCOME of one stream of all three kinds of events (side O, P or S; payments that count only)."""
    return folded_table(events_of(events, key, side, time, event, seq), lambda: ElasticFold(u, v + g, lateness), OUTCOME)


def elastic_stream(events: DataFrame, u: int, v: int, g: int, lateness: int | None = None, key: str = "key", side: str = "side", time: str = "t", event: str = "event", seq: str = "_seq") -> DataFrame:
    """The same over a live stream. With a lateness, state is bounded by the events within it and the windows."""
    return folded_stream(events_of(events, key, side, time, event, seq), lambda: ElasticFold(u, v + g, lateness), OUTCOME)
