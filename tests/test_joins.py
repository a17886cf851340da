import random

import pytest
from pyspark.sql import functions as F

from tideframe.operators import elastic, interval, metrics, relational

LEFT, RIGHT = "k int, l int, lt long", "rk int, r int, rt long"


def sides(spark, seed, n=40, keys=3):
    rnd = random.Random(seed)
    a = [(rnd.choice([*range(keys), None]), i, rnd.choice([*range(-50, 50), None])) for i in range(n)]
    b = [(rnd.choice([*range(keys), None]), i, rnd.choice([*range(-50, 50), None])) for i in range(n)]
    return a, b, spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT)


@pytest.mark.parametrize(("lower", "upper", "li", "ui"), [(0, 10, True, True), (-7, 3, True, False), (0, 0, True, True), (-20, -5, False, True)])
def test_interval_join_is_exact(spark, lower, upper, li, ui):
    a, b, left, right = sides(spark, lower + 100)
    lo, hi = lower + (not li), upper - (not ui)
    want = sorted((x[1], y[1]) for x in a for y in b if None not in (*x, *y) and x[0] == y[0] and x[2] + lo <= y[2] <= x[2] + hi)
    got = interval.interval_join(left, right, "lt", "rt", lower, upper, [("k", "rk")], lower_inclusive=li, upper_inclusive=ui)
    assert sorted((r.l, r.r) for r in got.collect()) == want
    theta = interval.interval_join(left, right, "lt", "rt", lower, upper, lower_inclusive=li, upper_inclusive=ui)
    assert theta.count() == sum(1 for x in a for y in b if None not in (x[2], y[2]) and x[2] + lo <= y[2] <= x[2] + hi)
    kept = interval.interval_join(left, right, "lt", "rt", lower, upper, [("k", "rk")], "left_anti", lower_inclusive=li, upper_inclusive=ui)
    assert {r.l for r in kept.collect()} == {x[1] for x in a} - {i for i, _ in want}
    semi = interval.interval_join(left, right, "lt", "rt", lower, upper, [("k", "rk")], "left_semi", lower_inclusive=li, upper_inclusive=ui)
    assert sorted(r.l for r in semi.collect()) == sorted({i for i, _ in want})
    outer = interval.interval_join(left, right, "lt", "rt", lower, upper, [("k", "rk")], "left", lower_inclusive=li, upper_inclusive=ui)
    assert sorted((r.l, r.r) for r in outer.collect() if r.r is not None) == want
    assert outer.count() == len(want) + len(a) - len({i for i, _ in want})


def test_inverted_interval_raises(spark):
    _, _, left, right = sides(spark, 1)
    with pytest.raises(ValueError):
        interval.interval_join(left, right, "lt", "rt", 5, 1)
    with pytest.raises(ValueError):
        interval.interval_join(left, right, "lt", "rt", 5, 6, lower_inclusive=False, upper_inclusive=False)


def test_names_of_the_sides(spark):
    left = spark.createDataFrame([(1, 5, "x", 1, 2, 3)], "k int, lt long, _lt string, _lb int, _rb int, _n int")
    right = spark.createDataFrame([(1, 7, "y")], "rk int, rt long, _rt string")
    got = interval.interval_join(left, right, "lt", "rt", 0, 5, [("k", "rk")])
    assert got.columns == [*left.columns, *right.columns] and tuple(got.first()) == (1, 5, "x", 1, 2, 3, 1, 7, "y")
    assert interval.first_match(left, ["k"], [F.col("lt")]).columns == left.columns
    with pytest.raises(ValueError):
        interval.interval_join(left, left, "lt", "lt", 0, 5)
    with pytest.raises(ValueError):
        interval.dynamic_join(left, right, "lt", "rt", 5, [])


def test_window_join_counts_each_shared_window(spark):
    a, b, left, right = sides(spark, 5)
    w = lambda t: {s for s in range(-80, 80, 5) if s <= t < s + 15}
    want = sorted((x[1], y[1], s) for x in a for y in b if None not in (*x, *y) and x[0] == y[0] for s in w(x[2]) & w(y[2]))
    got = interval.window_join(left, right, "lt", "rt", 15, 5, [("k", "rk")])
    assert sorted((r.l, r.r, r.w_start) for r in got.collect()) == want


def test_dynamic_join_modes(spark):
    left = spark.createDataFrame([(1, 1, 0), (2, 2, 0)], LEFT)
    right = spark.createDataFrame([(1, 7, 4), (1, 8, 5), (1, 6, -3)], RIGHT)
    run = lambda **m: sorted((r.l, r.r or 0) for r in interval.dynamic_join(left, right, "lt", "rt", 5, [("k", "rk")], probe_id=["l"], **m).collect())
    assert run() == [(1, 6), (1, 7), (2, 0)]
    assert run(mode="incremental") == [(1, 6), (1, 7)]
    assert run(first=True) == [(1, 6), (2, 0)]


def test_lateness_is_strict(spark):
    e = spark.createDataFrame([(1, 10), (2, 20), (3, 15), (4, 14), (5, 30)], "seq int, t long")
    got = interval.with_lateness(e, "t", "seq", 5, F.lit("left")).orderBy("seq").collect()
    assert [r._tag for r in got] == ["on-time", "on-time", "on-time", "left-late", "on-time"]


NAMES = elastic.Streams("o", "o", "ot", "po", "p", "pt", "so", "s", "st")


def policy_table(spark):
    o = spark.createDataFrame([(f"O{i + 1}", 10 * i) for i in range(10)], "o string, ot long")
    p = spark.createDataFrame([("O1", "P1", 30, "PAID"), ("O2", "P2", 75, "PAID"), ("O3", "P3", 120, "PAID"), ("O4", "P4", 50, "PAID"), ("O5", "P5", 60, "PAID"), ("O7", "P7", 90, "PAID"), ("O8", "P8a", 100, "PAID"), ("O8", "P8b", 120, "PAID"), ("O9", "P9", 110, "FAILED"), ("O10", "P10", 85, "PAID"), ("O10", "P10b", 140, "PAID")], "po string, p string, pt long, status string")
    s = spark.createDataFrame([("O1", "S1", 50), ("O2", "S2", 80), ("O3", "S3", 90), ("O4", "S4", 180), ("O6", "S6", 100), ("O7", "S7a", 100), ("O7", "S7b", 130), ("O8", "S8", 120), ("O9", "S9", 130), ("O10", "S10", 150)], "so string, s string, st long")
    return o, p, s


def test_elastic_policy_table(spark):
    o, p, s = policy_table(spark)
    good = F.col("status") == "PAID"
    rows = lambda v: {(r.o, r.p, r.s) for r in elastic.elastic_validation(o, p, s, 100, v, 30, good, NAMES).collect()}
    strict = {("O1", "P1", "S1"), ("O2", "P2", "S2"), ("O7", "P7", "S7a"), ("O7", "P7", "S7b"), ("O8", "P8a", "S8"), ("O10", "P10b", "S10")}
    assert rows(50) == strict
    assert rows(80) == strict | {("O3", "P3", "S3")}
    status = {r.o: r.status for r in elastic.elastic_status(o, p, s, 100, 50, 30, F.lit(1000), good, NAMES).collect()}
    assert status == {"O1": "VALID", "O2": "VALID", "O3": "INVALID", "O4": "NO_CONTENT", "O5": "NO_CONTENT", "O6": "INVALID", "O7": "VALID", "O8": "VALID", "O9": "INVALID", "O10": "VALID"}


def test_elastic_windowing_modes(spark):
    o = spark.createDataFrame([("A", 10)], "o string, ot long")
    p = spark.createDataFrame([("A", "P", 14)], "po string, p string, pt long")
    s = spark.createDataFrame([("A", "S", 17)], "so string, s string, st long")
    n = lambda mode, ext=0: elastic.elastic_windowing(o, p, s, 5, 3, 2, mode, ext, None, NAMES).count()
    assert (n("fixed"), n("elastic"), n("extended", 3)) == (0, 1, 1)


def test_metrics_and_streams(spark):
    found = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5), ("x", 9)], "k string, lat long")
    truth = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    one = metrics.evaluate(found, truth, ["k"], "lat").first()
    assert (one.tp, one.fp, one.fn, one.duplicates, one.lat_median) == (2, 1, 1, 1, 3.0)
    now, before = spark.createDataFrame([(1,), (1,), (2,)], "v int"), spark.createDataFrame([(1,), (3,)], "v int")
    assert sorted(r.v for r in relational.istream(now, before).collect()) == [1, 2]
    assert [r.v for r in relational.dstream(now, before).collect()] == [3]


def test_changes_between_instants(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (4, "c")], "at long, v string")
    instants = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "at long")
    got = sorted((r["at"], r.v, r.change) for r in relational.changes(rows, "at", instants, F.lit(1)).collect())
    assert got == [(1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "a", -1), (2, "b", -1), (3, "a", -1), (4, "c", 1)]


def test_closure(spark):
    h = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")], "sub string, super string")
    got = {tuple(r) for r in relational.closure(h).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("x", "x")}


def test_graph_steps(spark):
    t = spark.createDataFrame([("a", "knows", "b"), ("b", "rdf:type", "Dog"), ("c", "knows", "c")], "s string, p string, o string")
    h = spark.createDataFrame([("Dog", "Animal")], "sub string, super string")
    got = relational.basic_graph_pattern(relational.upward(t, h), [("?x", "knows", "?y"), ("?y", "rdf:type", "Animal")])
    assert [(r.x, r.y) for r in got.collect()] == [("a", "b")]
    assert [r.x for r in relational.triple_pattern(t, "?x", "knows", "?x").collect()] == ["c"]
