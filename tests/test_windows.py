import random

from pyspark.sql import functions as F

from tideframe.operators import windows


def test_hopping_latest_trace(spark):
    e = spark.createDataFrame([(t,) for t in (2000, 4000, 5000, 5500, 7000)], "ts long")
    got = windows.hopping_latest(e, "ts", 1000, 1000)
    full = windows.content_of(got, e, "ts", F.count("*").alias("n")).orderBy("eval_ts").collect()
    assert [(r.eval_ts, r.w_open, r.w_close, r.n or 0) for r in full] == [(4000, 2000, 3000, 1), (5000, 3000, 4000, 0), (5500, 4000, 5000, 1), (7000, 5000, 6000, 2)]


def step_model(times, width, slide):
    """Windows as a clock would open, report and evict them."""
    held, now, out = set(), None, []
    for t in sorted(set(times)):
        close = -(-t // slide) * slide
        while True:  # at least one window opens, even if it begins later
            held.add(close)
            close += slide
            if close - width > t:
                break
        if now is not None:
            ready = [c for c in held if c < t]
            if ready:
                out.append((t, max(ready) - width, max(ready)))
            held -= set(ready)
        now = t
    return out


def test_hopping_latest_against_step_model(spark):
    rnd = random.Random(7)
    for _ in range(6):
        width, slide = rnd.randint(1, 12), rnd.randint(1, 12)
        times = [rnd.randint(1, 80) for _ in range(rnd.randint(2, 25))]
        e = spark.createDataFrame([(t,) for t in times], "ts long")
        got = sorted(tuple(r) for r in windows.hopping_latest(e, "ts", width, slide).collect())
        assert got == step_model(times, width, slide), (times, width, slide)


def test_hopping_gaps_and_edges(spark):
    e = spark.createDataFrame([(t,) for t in (0, 9, 10, 14, 15, None)], "ts long")
    got = sorted((r.ts, r.w_open, r.w_close) for r in windows.hopping(e, "ts", 5, 15).collect())
    assert got == [(10, 10, 15), (14, 10, 15)]


def test_frames_part_the_stream(spark):
    e = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 60, 30, 20, 90, 5])], "k int, seq int, v double")
    got = windows.stateful_frames(e, float, lambda s, r: s + r["v"], lambda s: s > 100, ["seq"], ["k"]).orderBy("seq").collect()
    assert [r.frame for r in got] == [0, 0, 0, 1, 2, 2]
    assert [r.frame for r in windows.count_frames(e, 4, ["seq"], ["k"]).orderBy("seq").collect()] == [0, 0, 0, 0, 1, 1]


def test_empty_table(spark):
    e = spark.createDataFrame([], "ts long, k int")
    assert windows.hopping(e, "ts", 5, 5).count() == 0
    assert windows.hopping_latest(e, "ts", 5, 5).count() == 0
