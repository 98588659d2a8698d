"""Indicators on row frames and running sums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.operators.indicators.registry import full, indicator, mid
from barloom.operators.spans import windowed


@indicator("sma", period=20)
def sma(bars, keys, period):
    """Mean of the last ``period`` mid closes."""
    return windowed(bars, keys, lambda df, w: df.withColumn("sma", full(F.avg, mid(), w, period)), period - 1)


@indicator("bbands", "lower", "middle", "upper", period=20, num_std=2.0)
def bbands(bars, keys, period, num_std):
    """The mean, and population standard deviations around it."""
    run = lambda df, w: df.withColumns({"middle": full(F.avg, mid(), w, period), "_std": full(F.stddev_pop, mid(), w, period)})
    bars = windowed(bars, keys, run, period - 1)
    return bars.withColumns({"lower": F.col("middle") - num_std * F.col("_std"), "upper": F.col("middle") + num_std * F.col("_std")}).drop("_std")


@indicator("vwap")
def vwap(bars, keys):
    """Volume-weighted typical price since the start of the New York trading day; null without volume."""
    typical = (mid("high") + mid("low") + mid("close")) / 3
    day = K.trading_day_start(F.col("open_time"), "ny")
    w = Window.partitionBy(*keys, "_day").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    bars = bars.withColumn("_day", day)
    return bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w))).drop("_day")


@indicator("donchian", "lower", "upper", "width", period=20)
def donchian(bars, keys, period):
    """Channel of the least low and greatest high, this bar included."""
    run = lambda df, w: df.withColumns({"lower": full(F.min, mid("low"), w, period), "upper": full(F.max, mid("high"), w, period)})
    bars = windowed(bars, keys, run, period - 1)
    return bars.withColumn("width", F.col("upper") - F.col("lower"))


@indicator("hist_vol", period=60)
def hist_vol(bars, keys, period):
    """Population standard deviation of log returns, not annualised."""

    def run(df, w):
        df = df.withColumn("_ret", F.ln(mid()) - F.ln(F.lag(mid()).over(w)))
        return df.withColumn("hist_vol", full(F.stddev_pop, F.col("_ret"), w, period)).drop("_ret")

    return windowed(bars, keys, run, period)
