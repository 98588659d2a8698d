"""The open-time index against the market calendar, minute by minute."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.operators import opening as O
from barloom.operators import quality as Q
from barloom.operators.resample import resample, source_coverage
from barloom.schema import Timeframe as T
from tests.helpers import minute_bars

#: Weeks with changes of the clocks, Christmas on a Thursday, New Year on a Sunday and on a Monday, and Good Friday.
WEEKS = ["2024-03-07", "2024-11-01", "2025-12-23", "2022-12-30", "2023-12-30", "2024-03-27"]
SPANS = "symbol string, start timestamp_ntz, stop timestamp_ntz"


def open_minutes(spark, start, days):
    t0 = datetime.fromisoformat(start)
    df = spark.range(days * 1440).select((F.lit(str(t0)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("t"))
    return t0, [r.o for r in df.select("t", K.is_market_open(F.col("t")).alias("o")).orderBy("t").collect()]


@pytest.mark.parametrize("start", WEEKS)
def test_open_minutes_between_any_times(spark, start):
    t0, is_open = open_minutes(spark, start, 9)
    rng, rows = random.Random(start), []
    for _ in range(150):
        a, b = sorted(rng.uniform(0, 9 * 1440) for _ in range(2))
        a, b = (round(a), round(b)) if rng.random() < 0.5 else (a, b)
        rows.append((t0 + timedelta(minutes=a), t0 + timedelta(minutes=b)))
    rows += [(t0, t0), (None, t0), (t0 + timedelta(minutes=5), t0)]
    got = O.with_open_minutes(spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz"), "a", "b", "n").collect()
    assert len(got) == len(rows)
    whole = lambda x: -(-(x - t0) // timedelta(minutes=1))
    for r in got:
        want = None if r.a is None else sum(is_open[whole(r.a) : whole(r.b)]) - sum(is_open[whole(r.b) : whole(r.a)])
        assert r.n == want, r


@pytest.mark.parametrize("start, timeframe", [(WEEKS[0], T.M1), (WEEKS[1], T.H4), (WEEKS[2], T.M5), (WEEKS[3], T.H1), (WEEKS[4], T.H4), (WEEKS[5], T.M1)])
def test_slots_and_gaps_equal_the_laid_out_grid(spark, start, timeframe):
    t0, is_open = open_minutes(spark, start, 10)
    first, m = t0 + timedelta(minutes=37), timeframe.minutes
    stop = first + timedelta(days=8, minutes=11)
    want = [k for k in range(0, 8 * 1440 + 11, m) if is_open[37 + k] or is_open[37 + k + m - 1]]
    due = O.due_slots(spark.createDataFrame([("X", first, stop), ("Y", stop, first)], SPANS), m)
    got = [r.open_time for r in O.slots(due, m).orderBy("open_time").collect()]
    assert got == [first + timedelta(minutes=k) for k in want]
    rng = random.Random(5)
    have = {k for k in want if rng.random() < 0.8} | {3} | {k for k in range(0, 2880, m)}
    bars = spark.createDataFrame([("X", first + timedelta(minutes=k)) for k in have], "symbol string, open_time timestamp_ntz")
    runs, last = [], None
    for k in want:
        if k not in have:
            if last == k - m:
                runs[-1][1:] = [k, runs[-1][2] + 1]
            else:
                runs.append([k, k, 1])
            last = k
    found = O.missing_runs(bars, due, m).orderBy("from").collect()
    assert [[int((r["from"] - first).total_seconds() // 60), int((r["to"] - first).total_seconds() // 60), r.missing_bars] for r in found] == runs
    assert all(r.minutes == r.missing_bars * m for r in found)


def test_no_bars_and_too_long_spans(spark):
    none = spark.createDataFrame([], SPANS)
    assert O.open_days(none).count() == 0 and O.slots(O.due_slots(none, 5), 5).count() == 0
    with pytest.raises(Exception, match="more than"):
        O.open_days(spark.createDataFrame([("X", datetime(1, 2, 1), datetime(2024, 1, 1))], SPANS)).collect()
    with pytest.raises(ValueError):
        O.due_slots(none, 1440)


def test_plans_lay_out_days_at_most(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 300)
    for df in (source_coverage(b, resample(b, T.H1), T.H1), Q.gaps_due(b, Q.due(b, T.M1), T.M1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        steps = [p.split(")")[0] for p in plan.split("sequence(")[1:]]
        assert steps and all("MINUTE" not in p for p in steps)  # days, and numbers of weeks
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
