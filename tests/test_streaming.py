import pytest
from pyspark.sql import functions as F

from tideframe.operators import adaptive, elastic, interval, windows
from tideframe.plans import catalog
from tideframe.plans.query import ContinuousQuery, Program
from tideframe.sources import generators, io
from tideframe.streaming import joins

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    e = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").write.parquet(path)
    return path, e.schema.simpleString(), e


def drained(df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def schema_of(e):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)


def test_interval_join_stream_equals_batch(spark, files, tmp_path):
    path, _, e = files
    side = lambda src, kind, x: joins.event(src.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{x}k"), F.col("event_id").alias(x), F.col("ts").alias(f"{x}t")), f"{x}t", "40 days")
    s1, s2 = (io.stream(spark, path, schema_of(e)) for _ in range(2))
    live = joins.stream_interval_join(side(s1, "click", "a"), side(s2, "view", "b"), "at", "bt", "0 hours", "48 hours", [("ak", "bk")])
    got = sorted((r.a, r.b) for r in drained(live, "live_pairs", str(tmp_path / "c")).collect())
    batch = interval.interval_join(side(e, "click", "a"), side(e, "view", "b"), "at", "bt", 0, 48 * 3600, [("ak", "bk")])
    assert got == sorted((r.a, r.b) for r in batch.collect()) and got


def test_hopping_stream_equals_batch(spark, files, tmp_path):
    path, _, e = files
    src = joins.event(io.stream(spark, path, schema_of(e)), "ts", "40 days")
    live = joins.stream_hopping(src, "ts", "3 hours", "2 hours", "1 hour", ["event_type"], F.count("*").alias("n"))
    got = {tuple(r) for r in drained(live, "live_hops", str(tmp_path / "c"), "complete").select("w_close", "event_type", "n").collect()}
    batch = windows.hopping(e, "ts", 3 * 3600, 2 * 3600).groupBy("w_close", "event_type").agg(F.count("*").alias("n"))
    assert got == {tuple(r) for r in batch.collect()}


def test_adaptive_stream_equals_batch(spark, tmp_path):
    orders, payments, _ = generators.two_streams(spark, 1)
    events = generators.arrivals(orders, payments)
    events.repartitionByRange(1, "_seq").sortWithinPartitions("_seq").write.parquet(str(tmp_path / "in"))
    events = spark.read.parquet(str(tmp_path / "in"))
    b = adaptive.Bounds(30, 10, 20, 90, 70)
    live = adaptive.adaptive_stream(io.stream(spark, str(tmp_path / "in"), schema_of(events)), b)
    got = sorted((r.left_id, r.right_id) for r in adaptive.pairs(drained(live, "live_adaptive", str(tmp_path / "c"))).collect())
    assert got == sorted((r.left_id, r.right_id) for r in adaptive.pairs(adaptive.adaptive_join(events, b)).collect()) and got


def test_elastic_stream_equals_batch(spark, tmp_path):
    e = catalog.three_sides(spark, D)
    top = e.agg(F.max("_seq")).first()[0] + 1
    for i in range(3):  # the files come one after the other
        e.where(F.floor(F.col("_seq") * 3 / top) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = spark.read.parquet(str(tmp_path / "in"))
    hour = 3_600_000_000
    live = elastic.elastic_stream(io.stream(spark, str(tmp_path / "in"), schema_of(e)), 48 * hour, 24 * hour, 12 * hour, 0)
    got = sorted(drained(live, "live_elastic", str(tmp_path / "c")).collect(), key=str)
    batch = elastic.elastic_fold(e, 48 * hour, 24 * hour, 12 * hour, 0)
    assert got == sorted(batch.collect(), key=str) and {r.kind for r in got} == {"VALID", "INVALID", "NO_CONTENT"}
    valid = {(int(r.order_id), int(r.payment_id), int(r.shipment_id)) for r in got if r.kind == "VALID"}
    assert valid == {tuple(r)[:3] for r in catalog.elastic_arrival(spark, D).collect()}, "events come in time order, so nothing expires early"


def test_elastic_fold_by_hand():
    fold = elastic.ElasticFold(100, 80, 10)
    take = lambda *e: fold.take(*e)
    assert take("P", 30, "p0") == [] and take("O", 20, "a") == []
    assert take("S", 50, "s1") == [("VALID", "a", "p0", "s1", 20)] and take("S", 55, "s2") == [], "it is final"
    assert take("O", 60, "b") == [] and take("O", 61, "c") == [] and take("P", 62, "p1") == []
    assert take("O", 40, "x") == [("late", "x", None, None, 40)]
    assert take("O", 170, "d") == [] and take("O", 171, "e") == [("NO_CONTENT", "b", "p1", None, 60)]
    assert take("O", 300, "f") == [("NO_CONTENT", "c", "p1", None, 61), ("INVALID", "d", None, None, 170), ("INVALID", "e", None, None, 171)]
    assert not fold.payments and not fold.shipments and list(fold.orders) == ["f"]


def test_late_rows_go_aside(spark, tmp_path):
    """Rows behind the watermark of the batches before, also across a restart and when a batch is run again."""
    seen, late = [], []
    path = str(tmp_path / "in")

    def put(i, t):
        spark.createDataFrame([(i, t)], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(path)

    def run():
        split = joins.LateSplitter("ts", 600, lambda d, _: seen.extend(r.id for r in d.collect()), lambda d, _: late.extend(r.id for r in d.collect()), str(tmp_path / "marks"))
        src = io.stream(spark, path, "id int, ts timestamp")
        src.writeStream.foreachBatch(split).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return split

    for i, t in enumerate(["2024-01-01 10:00:00", "2024-01-01 09:00:00", "2024-01-01 09:50:00"]):
        put(i, t)
        run()  # each run is a query started again
    assert (seen, late) == ([0, 2], [1])
    put(3, "2024-01-01 09:49:59")
    split = run()
    assert late == [1, 3]
    again = spark.createDataFrame([(9, "2024-01-01 09:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    split(again, 0)
    assert seen == [0, 2, 9], "the first batch, run again, has no watermark"


def test_sessions_and_window_join_streams(spark, files, tmp_path):
    path, _, e = files
    src = joins.event(io.stream(spark, path, schema_of(e)), "ts", "40 days")
    got = drained(joins.stream_sessions(src, "ts", "12 hours", ["user_id"], F.count("*").alias("n")), "live_sessions", str(tmp_path / "c1"), "complete")
    batch = windows.session_frames(e, "ts", 12 * 3600 - 1e-6, ["ts"], ["user_id"]).groupBy("user_id", "frame").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    assert sorted((r.user_id, r.w.start, r.n) for r in got.collect()) == sorted((r.user_id, r["first"], r.n) for r in batch.collect())
    side = lambda df, kind, x: df.where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{x}k"), F.col("event_id").alias(x), F.col("ts").alias(f"{x}t"))
    s1, s2 = (joins.event(side(io.stream(spark, path, schema_of(e)), kind, x), f"{x}t", "40 days") for kind, x in (("click", "a"), ("view", "b")))
    live = drained(joins.stream_window_join(s1, s2, "at", "bt", "12 hours", "4 hours", [("ak", "bk")]), "live_windows", str(tmp_path / "c2"))
    want = interval.window_join(side(e, "click", "a"), side(e, "view", "b"), "at", "bt", 12 * 3600, 4 * 3600, [("ak", "bk")])
    assert sorted((r.a, r.b, r.w.start) for r in live.collect()) == sorted((r.a, r.b, r.w_start) for r in want.collect()) and live.count()


def test_sinks(spark, files, tmp_path):
    path, _, e = files
    q = io.to_files(io.stream(spark, path, schema_of(e), files_at_once=2), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
    io.to_files(io.stream(spark, path, schema_of(e)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count(), "a restarted query reads nothing twice"
    m = io.to_memory(io.stream(spark, path, schema_of(e)), "in_memory")
    m.processAllAvailable()
    m.stop()
    assert spark.table("in_memory").count() == e.count()
    parts = io.partitioned(e, 5, "user_id").select("user_id", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == parts.select("user_id").distinct().count()
    assert io.rate(spark, 5).isStreaming


def test_program_and_views(spark, files, tmp_path):
    path, _, e = files
    q = ContinuousQuery("by_user", {"events": lambda d: d.where("event_type = 'click'")}, lambda r: r["events"].groupBy("user_id").agg(F.count("*").alias("n")))
    program = Program()
    program.add_stream("events", e)
    out = program.register(q, "counts")
    with pytest.raises(ValueError):
        program.register(q)
    after = ContinuousQuery("busy", {"counts": lambda d: d}, lambda r: r["counts"].where("n > 1"))
    assert program.register(after).count() == out.where("n > 1").count()
    program.unregister("by_user")
    program.unregister("unknown")
    assert program.register(q, "counts").columns == out.columns, "its output is free again"
    with pytest.raises(ValueError):
        program.register(ContinuousQuery("other", q.inputs, q.relate), "counts")
    assert "other" not in program.queries
    program.unregister("by_user")
    view = program.view(q, {"events": "ts"})
    half = view.at(F.lit("2024-01-15").cast("timestamp"))
    assert 0 < half.agg(F.sum("n")).first()[0] < out.agg(F.sum("n")).first()[0]
    live, got = Program(), []
    live.add_stream("events", io.stream(spark, path, schema_of(e)))
    clicks = ContinuousQuery("clicks", {"events": lambda d: d.where("event_type = 'click'")}, lambda r: r["events"])
    live.register(clicks)
    live.start("clicks", str(tmp_path / "c2"), [lambda d, _: got.append(d.count()), lambda d, _: got.append(d.count())]).awaitTermination()
    assert sum(got) == 2 * e.where("event_type = 'click'").count()
    live.unregister("clicks")


def test_sources(spark, tmp_path):
    o = spark.createDataFrame([("O1", "C", 1.5, 10)], io.ORDERS)
    io.to_csv(o, str(tmp_path / "o"))
    assert io.table(spark, str(tmp_path / "o"), io.ORDERS, "csv").collect() == o.collect()
    with pytest.raises(ValueError):
        io.table(spark, "x", kind="csv")
    orders, payments, shipments, cases = generators.case_streams(spark, 3)
    truth = generators.ground_truth(orders, payments, shipments, 100, 50, 30)
    kinds = {r.category: r["count"] for r in truth.join(cases, "orderId").groupBy("category").count().collect()}
    assert kinds == {k: 3 * n * len(ships) for k, (n, pays, ships) in generators.CATEGORIES.items() if pays and ships}
    assert truth.where("not paymentId like 'P%0'").isEmpty(), "the first paid one"
    orders, payments, shipments = generators.integrity_streams(spark, 2000)
    assert [df.schema.simpleString() for df in (orders, payments, shipments)] == [spark.createDataFrame([], s).schema.simpleString() for s in (io.ORDERS, io.PAYMENTS, io.SHIPMENTS)]
    late = payments.join(orders.select("orderId", F.col("t").alias("tO")), "orderId").where("t > tO + 80 and paymentId like 'P%'").count()
    assert 120 < late < 250 and 120 < 2000 - payments.where("paymentId like 'P%'").count() < 280
    both = generators.arrivals(*generators.two_streams(spark, 4)[:2]).orderBy("_seq").collect()
    back = sum(a.t > b.t for a, b in zip(both, both[1:], strict=False))
    assert len({r["_seq"] for r in both}) == len(both) and 0 < back < 0.2 * len(both)
    p = spark.createDataFrame([("P1", "O1", "FAILED", 1.5, 12), ("P2", "O1", "PAID", 1.5, 50)], io.PAYMENTS)
    s = spark.createDataFrame([("S1", "O1", "x", 60), ("S2", "O1", "x", 111)], io.SHIPMENTS)
    got = generators.ground_truth(o, p, s, 100, 50, 30).collect()
    assert [tuple(r) for r in got] == [("O1", "P2", "S1", 10, 50, 60)]
