"""Interval joins and segments against nested loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import edge as E
from barloom.operators import interval_join as J
from tests.helpers import minute_bars

T0 = datetime(2026, 1, 5)
POINTS, INTERVALS = "symbol string, at timestamp_ntz, n int", "symbol string, start timestamp_ntz, stop timestamp_ntz, tag int"


def some(seed):
    rng = random.Random(seed)
    time = lambda most: T0 + timedelta(seconds=rng.choice([rng.randrange(most), rng.uniform(0, most)]))
    points = [(rng.choice("XY"), time(10**6), i) for i in range(300)] + [("X", None, -1), (None, T0, -2), ("X", T0, -3), ("X", T0, -3), ("X", datetime(1950, 1, 1), -4)]
    intervals = []
    for i in range(120):
        a = time(10**6)
        intervals.append((rng.choice("XYZ"), a, a + timedelta(seconds=rng.choice([0, -5, 0.000001, 59, 60, 61, 3600, 10**5 * rng.random(), 10**8])), i))
    return points, intervals + [("X", T0, T0 + timedelta(seconds=1), 500), ("X", None, T0, 501), ("X", T0, None, 502), ("X", datetime(1900, 1, 1), datetime(2100, 1, 1), 503)]


@pytest.mark.parametrize("seed", [1, 2])
def test_points_meet_every_interval_that_holds_them(spark, seed):
    points, intervals = some(seed)
    p, i = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    holds = lambda x, y: x[0] == y[0] and None not in (x[0], x[1], y[1], y[2]) and y[1] <= x[1] < y[2]
    joined = J.points_in_intervals(p, i, ["symbol"], "at")
    want = sorted((x[2], y[3]) for x in points for y in intervals if holds(x, y))
    assert sorted((r.n, r.tag) for r in joined.collect()) == want and len(want) > 300
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    inside = [any(holds(x, y) for y in intervals) for x in points]
    for how, keep in (("left_semi", True), ("left_anti", False)):
        assert sorted(r.n for r in J.points_in_intervals(p, i, ["symbol"], "at", how=how).collect()) == sorted(x[2] for x, h in zip(points, inside, strict=True) if h == keep)


def test_a_long_interval_is_two_rows_and_guards(spark):
    points, intervals = some(3)
    p, i = spark.createDataFrame(points, POINTS), spark.createDataFrame(intervals, INTERVALS)
    assert J.points_in_intervals(p, i.limit(0), ["symbol"], "at").count() == 0
    assert J.points_in_intervals(p, i.limit(0), ["symbol"], "at", how="left_anti").count() == len(points)
    with pytest.raises(ValueError, match="how"):
        J.points_in_intervals(p, i, ["symbol"], "at", how="outer")
    with pytest.raises(ValueError, match="both"):
        J.points_in_intervals(p.withColumnRenamed("n", "tag"), i, ["symbol"], "at")
    assert len(J.levels_of(i)) < J.LEVELS


def test_segments_end_where_bad_stretches_begin(spark):
    b = minute_bars(spark, "2026-01-31 23:00", 180).union(minute_bars(spark, "2026-02-01 00:00", 5, symbol="Y"))
    t = lambda m, s=0: datetime(2026, 1, 31, 23) + timedelta(minutes=m, seconds=s)
    rng = random.Random(4)
    bad = [("X", t(10), t(10, 1)), ("X", t(20), t(25)), ("X", t(24), t(30, 30)), ("X", t(70), t(70)), ("Z", t(0), t(99)), ("X", t(200), t(300)), ("X", t(-5), t(0))]
    bad += [("X", t(m, 30), t(m, 40)) for m in rng.sample(range(60, 180), 6)]
    df = spark.createDataFrame(bad, "symbol string, start timestamp_ntz, stop timestamp_ntz")
    got = {(r.symbol, r.open_time): r.segment for r in J.segments(b, df).collect()}
    hits = lambda s, x: [y for y in bad if y[0] == s and y[1] < y[2] and y[1] < x + timedelta(minutes=1) and y[2] > x]
    rows = [(r.symbol, r.open_time) for r in b.collect()]
    assert set(got) == {r for r in rows if not hits(*r)}
    begun = lambda s, x: sum(y[0] == s and y[1] < y[2] and y[1] < x + timedelta(minutes=1) for y in bad)
    for a in got:
        for z in got:
            if a[0] == z[0]:
                assert (got[a] == got[z]) == (begun(*a) == begun(*z))


def test_no_return_crosses_a_removed_stretch(spark):
    b = minute_bars(spark, "2026-01-05 10:00", 60).withColumn("signal", F.lit(True))
    cut = datetime(2026, 1, 5, 10, 30)
    bad = spark.createDataFrame([("X", cut, cut + timedelta(seconds=1))], "symbol string, start timestamp_ntz, stop timestamp_ntz")
    r = {x.horizon: x for x in E.scan_excluding(b, bad, horizons=(1, 10, 29, 30)).collect()}
    # 30 bars before and 29 after; each part loses its last h
    assert {h: x.n for h, x in r.items()} == {1: 57, 10: 39, 29: 1, 30: 0} and r[1].n_signals == 59
    whole = {x.horizon: x.n for x in E.scan(b, horizons=(10,)).collect()}
    assert whole == {10: 50}
    # a stretch without bars cuts too
    gap = b.where("minute(open_time) < 20 OR minute(open_time) >= 25")
    hole = spark.createDataFrame([("X", cut - timedelta(minutes=8), cut - timedelta(minutes=7))], "symbol string, start timestamp_ntz, stop timestamp_ntz")
    assert [x.n for x in E.scan_excluding(gap, hole, horizons=(10,)).collect()] == [10 + 25]
