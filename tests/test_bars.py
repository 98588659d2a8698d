import pytest
from pyspark.sql import functions as F

from barloom.operators.resample import resample, source_coverage
from barloom.operators.validate import combine_sides, project_bars, validate_bars
from barloom.operators import quality as Q
from barloom.schema import Timeframe as T
from barloom.schema import empty_bars
from tests.helpers import minute_bars


def test_first_five_minutes(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 12).repartition(3)
    r = resample(b, T.M5).orderBy("open_time").collect()
    assert len(r) == 2  # the third bucket is not confirmed
    assert [round(x, 6) for x in (r[0].bid_open, r[0].bid_high, r[0].bid_low, r[0].bid_close, r[0].volume)] == [150.0, 150.54, 149.5, 150.24, 50.0]
    assert resample(b, T.M5, confirmed=False).count() == 3


def test_week_of_new_york(spark):
    b = minute_bars(spark, "2026-01-04 15:00", 60 * 24 * 12)
    r = resample(b, T.W1_NY).collect()
    assert [(str(x.open_time), str(x.close_time)) for x in r] == [("2026-01-04 22:00:00", "2026-01-11 22:00:00")]


def test_days_hold_their_minutes_across_the_change_of_clocks(spark):
    b = minute_bars(spark, "2026-03-06 22:00", 60 * 24 * 5)
    days = resample(b, T.D1_NY)
    spans = {str(r.open_time): (r.close_time - r.open_time).total_seconds() / 60 for r in days.collect()}
    assert spans["2026-03-07 22:00:00"] == 1380 and {r.volume for r in days.where("open_time = TIMESTAMP_NTZ'2026-03-07 22:00:00'").collect()} == {13800.0}


def test_guards(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 3)
    with pytest.raises(ValueError):
        resample(b, T.M1)
    with pytest.raises(ValueError):
        resample(b.withColumn("open_time", F.col("open_time").cast("timestamp")), T.M5)
    assert resample(empty_bars(spark), T.D1_JST).schema.names == b.schema.names


@pytest.mark.parametrize(
    "change, rule",
    [
        (lambda d: d.union(d.limit(1)), "duplicate_open"),
        (lambda d: d.withColumn("close_time", F.col("close_time") + F.expr("interval 1 second")), "bad_span"),
        (lambda d: d.withColumn("volume", F.lit(float("inf"))), "not_finite"),
        (lambda d: d.withColumn("ask_low", F.lit(1.0)), "ask_below_bid"),
    ],
)
def test_validation(spark, change, rule):
    b = minute_bars(spark, "2026-01-05 00:00", 5)
    assert validate_bars(b.withColumn("more", F.lit(1)), T.M1).columns == b.columns
    with pytest.raises(ValueError, match=rule):
        validate_bars(change(b), T.M1)
    with pytest.raises(ValueError, match="missing"):
        project_bars(b.drop("volume"))


def test_sides_meet_on_time(spark):
    side = lambda rows: spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double, volume double")
    from datetime import datetime

    t = [datetime(2026, 1, 5, 0, i) for i in range(3)]
    got = combine_sides(side([("X", t[0], *[1.0] * 4, 5.0), ("X", t[1], *[1.0] * 4, 6.0)]), side([("X", t[1], *[2.0] * 4, 9.0), ("X", t[2], *[2.0] * 4, 9.0)]), T.M1).collect()
    assert [(r.open_time, r.ask_open, r.volume) for r in got] == [(t[1], 2.0, 6.0)]


def test_gaps_and_invariant(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 240, keep=lambda t: not (t.hour == 2 and t.minute < 10))
    r = Q.check(b, T.M1).first()
    assert [tuple(g) for g in r.gaps] == [("2026-01-05 02:00:00+00:00", "2026-01-05 02:09:00+00:00", 10, 10.0)]
    assert r.expected_bars == r.actual_bars + r.missing_bars == 240
    with pytest.raises(ValueError):
        Q.check(b, T.D1_NY)


def test_duplicates(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 4)
    d = b.union(b.limit(2)).union(b.where(F.minute("open_time") == 0).withColumn("volume", F.lit(1.0)))
    r = Q.dup_counts(d).first()
    assert (r.duplicate_count, r.conflicting_count) == (3, 1)
    assert Q.deduped(d).count() == 4


def test_coverage_counts_open_minutes(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 600, keep=lambda t: t.minute % 2 == 0 or t.hour >= 4)
    r = {x.open_time.hour: x.coverage for x in source_coverage(b, resample(b, T.H4), T.H4).collect()}
    assert r == {0: 0.5, 4: 1.0}
