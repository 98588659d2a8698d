"""Merged sketches against exact quantiles, and the look-ahead sweep against planted leaks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import spreads as S
from barloom.operators.indicators import REGISTRY, indicator
from barloom.operators.indicators.lookahead import lookahead_violations
from barloom.schema import BAR_SCHEMA
from tests.helpers import minute_bars


def test_merged_days_are_within_the_stated_error(spark, tmp_path):
    n, t0 = 60_000, datetime(2026, 3, 2)
    x = np.random.default_rng(1).lognormal(0, 1, n)
    rows = spark.range(n).select(F.lit("X").alias("symbol"), (F.lit(str(t0)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("open_time"), F.col("id"))
    spread = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, ask_close double")
    bars = rows.join(spread, "id").withColumn("bid_close", F.lit(0.0))
    S.spread_sketches(bars).write.parquet(str(tmp_path / "days"))  # as it is stored
    days = spark.read.parquet(str(tmp_path / "days"))
    assert days.groupBy("day").count().count() >= 42 and days.agg(F.sum("n")).first()[0] == n
    got = S.spread_quantiles(days, (0.1, 0.5, 0.9, 0.99)).collect()
    local = [(t0 + timedelta(minutes=i, hours=-5 if t0 + timedelta(minutes=i) < datetime(2026, 3, 8, 7) else -4)).hour for i in range(n)]
    off = []
    for r in got:
        own = np.sort(x[np.array(local) == r.hour])
        assert (r.n, r.least, r.most) == (len(own), own[0], own[-1])
        off += [abs(np.searchsorted(own, v) / len(own) - q) for q, v in ((0.1, r.p10), (0.5, r.p50), (0.9, r.p90), (0.99, r.p99))]
    assert len(got) == 24 and np.mean(np.array(off) <= S.rank_error()) > 0.95 and max(off) < 3 * S.rank_error()
    assert days.agg(F.max(F.length("sketch"))).first()[0] < 3000  # hardly grows with the bars


def test_small_and_odd_spreads(spark):
    t = datetime(2026, 1, 5, 12)
    rows = [("X", t, None, *[1.0] * 3, float(b), *[1.0] * 3, float(a), 1.0) for b, a in ((1, 2), (1, 1), (2, 1), (1, float("nan")))]
    bars = spark.createDataFrame(rows, BAR_SCHEMA).unionByName(minute_bars(spark, "2026-01-05 12:00", 1, symbol="Y").withColumn("ask_close", F.lit(None).cast("double")))
    assert [(r.symbol, r.hour, r.n, r.least, r.p50, r.most) for r in S.spread_quantiles(S.spread_sketches(bars)).collect()] == [("X", 7, 3, -1.0, 0.0, 1.0)]
    assert S.spread_quantiles(S.spread_sketches(bars.limit(0))).count() == 0


@pytest.fixture
def leaks():
    def add(name, look):
        @indicator(name)
        def fn(bars, keys):
            w = Window.partitionBy(*keys).orderBy("open_time")
            return bars.withColumn(name, look(w))

    add("leak_next", lambda w: F.lead("bid_close", 1).over(w))
    add("leak_rare", lambda w: F.when(F.minute("open_time") == 40, F.lead("bid_close", 30).over(w)).otherwise(F.col("bid_close")))
    add("leak_mean", lambda w: F.avg("bid_close").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    add("honest", lambda w: F.lag("bid_close", 3).over(w))
    yield ["leak_next", "leak_rare", "leak_mean", "honest"]
    for n in ("leak_next", "leak_rare", "leak_mean", "honest"):
        REGISTRY.pop(n)


def some_bars(spark, n=120):
    rng = random.Random(3)
    x = [150 + rng.gauss(0, 0.05) for _ in range(n)]
    return minute_bars(spark, "2026-01-05 21:00", n, price=lambda i: x[i]).union(minute_bars(spark, "2026-01-05 23:30", 20, symbol="Y"))


def test_planted_leaks_are_caught(spark, leaks):
    cuts = [1, 50, 60, 119]
    got = {(r.indicator, r.symbol, r.cut): (r.violations, r.first) for r in lookahead_violations(some_bars(spark), leaks, cuts).collect()}
    at = lambda k: datetime(2026, 1, 5, 21) + timedelta(minutes=k)
    assert {c: got["leak_next", "X", c] for c in cuts} == {c: (1, at(c - 1)) for c in cuts}
    assert {c: got.get(("leak_rare", "X", c)) for c in cuts} == {1: None, 50: (1, at(40)), 60: (1, at(40)), 119: None}  # at 119 what it would see is not there yet either
    assert got["leak_mean", "X", 50][0] == 50 and ("leak_mean", "Y", 50) not in got  # the whole of Y is within the cut
    assert not any(k[0] == "honest" for k in got)
    with pytest.raises(ValueError):
        lookahead_violations(some_bars(spark), cuts=[0])


def test_the_whole_registry_looks_back_only(spark):
    assert lookahead_violations(some_bars(spark), cuts=[1, 2, 14, 15, 33, 60, 61, 119]).collect() == []
