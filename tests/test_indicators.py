"""Values against plain loops, and no indicator sees later bars: its values on a prefix are those on the whole."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.indicators import REGISTRY, compute, indicator
from barloom.operators.indicators.recursive import ewm
from tests.helpers import minute_bars

N = 120


@pytest.fixture(scope="module")
def bars(spark):
    x = np.random.default_rng(5).normal(0, 0.02, N).cumsum() + 150
    return minute_bars(spark, "2026-01-05 21:00", N, price=lambda i: float(x[i])).cache()


def column(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("open_time").collect()]


def mids(bars):
    return [x[0] for x in column(bars.withColumn("m", (F.col("bid_close") + F.col("ask_close")) / 2), "m")]


def test_rsi_and_ema_are_the_loops(spark, bars):
    x = mids(bars)
    ema, rsi, gain, loss = [x[0]], [None], 0.0, 0.0
    for i in range(1, N):
        ema.append(ema[-1] + 2 / 21 * (x[i] - ema[-1]))
        d = x[i] - x[i - 1]
        g, s = max(d, 0.0), max(-d, 0.0)
        gain, loss = (g, s) if i == 1 else (gain + (g - gain) / 14, loss + (s - loss) / 14)
        rsi.append(None if i < 14 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
    got = column(compute(compute(bars, "ema"), "rsi"), "ema", "rsi")
    for (e, r), a, b in zip(got, ema, rsi):
        assert e == pytest.approx(a, rel=1e-11) and (r is None) == (b is None) and (b is None or r == pytest.approx(b, rel=1e-9))


@pytest.mark.parametrize("alpha", [1.0, 0.9, 0.5, 2 / 21, 2 / 201])
def test_blocks_of_the_recursion(spark, alpha):
    n = 1500
    b = minute_bars(spark, "2026-01-05 00:00", n, price=lambda i: math.sin(i) * 50 + 100)
    x, y = mids(b), []
    for v in x:
        y.append(v if not y else y[-1] + alpha * (v - y[-1]))
    got = [r[0] for r in column(ewm(b, ["symbol"], (F.col("bid_close") + F.col("ask_close")) / 2, alpha, "y"), "y")]
    assert np.allclose(got, y, rtol=1e-11, atol=1e-11)


def cut_sweep(spark, bars, fn, names):
    """Values on every prefix of some lengths, in one job, beside those on the whole."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    cuts = spark.createDataFrame([(k,) for k in (1, 2, 14, 15, 33, 59, 60, 61, 90, N)], "cut int")
    many = bars.withColumn("pos", F.row_number().over(w)).crossJoin(cuts).where("pos <= cut")
    part = fn(many, ["symbol", "cut"]).select("cut", "open_time", *names)
    whole = fn(bars, ["symbol"]).select("open_time", *(F.col(n).alias(f"_{n}") for n in names))
    both = part.join(whole, "open_time")
    return [both.where(~F.col(n).eqNullSafe(F.col(f"_{n}"))).count() for n in names], part.count()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_look_ahead(spark, bars, name):
    it = REGISTRY[name]
    wrong, n = cut_sweep(spark, bars, lambda df, keys: it.fn(df, keys, **it.defaults), it.outputs)
    assert wrong == [0] * len(it.outputs) and n == sum((1, 2, 14, 15, 33, 59, 60, 61, 90, N))
    last = column(compute(bars, name), *it.outputs)[-1]
    assert all(v is not None and math.isfinite(v) for v in last)


CHEATS = {
    "lead": lambda df, k: df.withColumn("y", F.lead("bid_close").over(Window.partitionBy(*k).orderBy("open_time"))),
    "centred": lambda df, k: df.withColumn("y", F.avg("bid_close").over(Window.partitionBy(*k).orderBy("open_time").rowsBetween(-2, 2))),
    "whole mean": lambda df, k: df.withColumn("y", F.col("bid_close") - F.avg("bid_close").over(Window.partitionBy(*k))),
    "backfill": lambda df, k: df.withColumn("y", F.first(F.when(F.minute("open_time") % 10 == 0, F.col("bid_close")), True).over(Window.partitionBy(*k).orderBy("open_time").rowsBetween(0, Window.unboundedFollowing))),
    "reversed sum": lambda df, k: df.withColumn("y", F.sum("volume").over(Window.partitionBy(*k).orderBy(F.desc("open_time")))),
    "rank": lambda df, k: df.withColumn("y", F.rank().over(Window.partitionBy(*k).orderBy("bid_close"))),
    "min max scale": lambda df, k: df.withColumn("y", F.col("bid_close") / F.max("bid_close").over(Window.partitionBy(*k))),
}


@pytest.mark.parametrize("cheat", sorted(CHEATS))
def test_the_sweep_catches_cheats(spark, bars, cheat):
    assert cut_sweep(spark, bars, CHEATS[cheat], ["y"])[0][0] > 0


def test_registry():
    with pytest.raises(ValueError):
        indicator("sma")(lambda b, k: b)
