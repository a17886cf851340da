import random

import pytest

from tideframe.operators.adaptive import Bounds, Fold, adaptations, adaptive_join, folded, pairs
from tideframe.operators import adaptive, metrics
from tideframe.sources import generators
from pyspark.sql import functions as F


def bounds(delta=5, top=50, **more):
    return Bounds(10, 10, delta, top, more.pop("beta_max", top), **more)


def test_first_record_widens():
    f = Fold(bounds(7, 100))
    assert f.add("L", 100, "a") == ([], (10, 10)) and (f.alpha, f.beta) == (17, 17)


def test_both_sides_widen_and_are_logged():
    f = Fold(bounds())
    out = folded(f, [("L", 100, "a"), ("R", 200, "b")])
    assert [(r[0], r[4]) for r in out] == [("adapted", "L"), ("adapted", "R")] and (f.alpha, f.beta) == (20, 20)


def test_cap_and_recovery():
    f = Fold(Bounds(10, 10, 100, 25, 30))
    f.add("L", 100, "a")
    assert (f.alpha, f.beta) == (25, 30)
    f = Fold(bounds())
    f.add("R", 112, "b")
    assert f.add("L", 100, "a")[0] == [(112, "b")]


def test_bad_bounds_raise():
    for bad in ({"delta": 0}, {"alpha_max": 1}, {"mode": "x"}):
        with pytest.raises(ValueError):
            Bounds(**{"alpha0": 5, "beta0": 5, "delta": 1, "alpha_max": 9, "beta_max": 9} | bad)


def plain(b, rows):
    """The rules word for word, without sorted buffers."""
    alpha, beta, seen, out = b.alpha0, b.beta0, [], []
    for side, t, e in rows:
        def found(al, be):
            lo, hi = (t - be, t + al) if side == "L" else (t - al, t + be)
            return [x for x in seen if x[0] != side and lo <= x[1] <= hi]

        if b.mode == "expand":
            if not found(alpha, beta):
                alpha, beta = min(alpha + b.delta, b.alpha_max), min(beta + b.delta, b.beta_max)
        else:
            while not found(alpha, beta) and (alpha, beta) != (b.alpha_max, b.beta_max):
                alpha, beta = min(alpha + b.delta, b.alpha_max), min(beta + b.delta, b.beta_max)
            while len(found(alpha, beta)) > 1 and (alpha, beta) != (b.alpha0, b.beta0):
                a2, b2 = max(alpha - b.delta, b.alpha0), max(beta - b.delta, b.beta0)
                if not found(a2, b2):
                    break
                alpha, beta = a2, b2
        out += sorted((e, x[2]) if side == "L" else (x[2], e) for x in found(alpha, beta))
        seen.append((side, t, e))
    return sorted(out), (alpha, beta)


@pytest.mark.parametrize("mode", ["expand", "expand_shrink"])
def test_fold_against_plain_rules(mode):
    rnd = random.Random(3)
    for _ in range(200):
        b = Bounds(rnd.randint(0, 5), rnd.randint(0, 5), rnd.randint(1, 6), rnd.randint(5, 20), rnd.randint(5, 20), mode)
        rows = [(rnd.choice("LR"), rnd.randint(0, 60), f"e{i}") for i in range(rnd.randint(0, 25))]
        f = Fold(b)
        got = sorted((r[1], r[2]) for r in folded(f, rows) if r[0] == "pair")
        assert (got, (f.alpha, f.beta)) == plain(b, rows)


@pytest.mark.parametrize("mode", ["expand", "expand_shrink"])
def test_generated_streams(spark, mode):
    """Distributed folds find what the plain rules find, and more than fixed bounds do."""
    orders, payments, truth = generators.two_streams(spark, 2)
    events = generators.arrivals(orders, payments)
    b = Bounds(30, 10, 20, 90, 70, mode)
    result = adaptive_join(events, b)
    got = sorted((r.left_id, r.right_id) for r in pairs(result).collect())
    by_key = {}
    for r in sorted(events.collect(), key=lambda r: (r._seq, r.side, r.t, r.event)):
        by_key.setdefault(r.key, []).append((r.side, r.t, r.event))
    assert got == sorted(p for rows in by_key.values() for p in plain(b, rows)[0])
    assert adaptations(result).count() > 0
    good = truth.where("correctPaymentId is not null").select(F.col("orderId").alias("left_id"), F.col("correctPaymentId").alias("right_id"))
    one = metrics.evaluate(pairs(result), good, ["left_id", "right_id"]).first()
    assert one.tp + one.fn == 200 and one.recall > 0.6


@pytest.mark.parametrize("mode", ["expand", "expand_shrink"])
def test_lateness_forgets_and_sets_aside(spark, mode):
    """Within the lateness nothing changes, and only what can still be reached is held."""
    rnd = random.Random(5)
    b = Bounds(3, 2, 2, 9, 7, mode)
    rows = [(rnd.choice("LR"), t + rnd.randint(-10, 0), f"e{t}") for t in range(400)]
    plain, fold = Fold(b), Fold(b, lateness=10)
    assert folded(plain, rows) == folded(fold, rows)
    assert len(plain.left) + len(plain.right) == 400 and len(fold.left) + len(fold.right) < 45
    top, kept = None, []
    for r in rows:
        if top is None or r[1] >= top - 4:
            kept.append(r)
        top = max(r[1], top if top is not None else r[1])
    out = folded(Fold(b, lateness=4), rows)
    assert [x for x in out if x[0] != "late"] == folded(Fold(b), kept)
    assert [x[1] or x[2] for x in out if x[0] == "late"] == [r[2] for r in rows if r not in kept]
    df = spark.createDataFrame([("k", *r, i) for i, r in enumerate(rows)], "key string, side string, t long, event string, _seq int")
    found = adaptive_join(df, b, lateness=4)
    assert adaptive.late(found).count() == len(rows) - len(kept)
