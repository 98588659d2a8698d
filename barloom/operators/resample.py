"""Higher time frames from minute bars, and how much of each the source covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.operators.opening import with_open_minutes
from barloom.operators.spans import quantile
from barloom.schema import BAR_COLUMNS, Timeframe, require_ntz
from barloom.sources.shared import materialized


def bucket(t: Column, timeframe: Timeframe) -> tuple[Column, Column]:
    """Open and close of the bar of ``timeframe`` that holds ``t``."""
    if timeframe is Timeframe.M1:
        raise ValueError("1m is the source, not a target")
    if timeframe.delta is not None:
        w = F.window(t, f"{timeframe.minutes} minutes")
        return w.start, w.end
    name, days = timeframe.convention, 7 if timeframe.weekly else 1
    key = K.local_trading_date(t, name)
    key = K.week_key(key) if timeframe.weekly else key
    return K.trading_period_start(key, name), K.trading_period_start(F.date_add(key, days), name)


def _keyed(bars: DataFrame, timeframe: Timeframe) -> DataFrame:
    """``bars`` with their bucket's open, as ``bucket``; its close follows from it."""
    if timeframe.delta is not None:
        return bars.withColumn("bucket", bucket(F.col("open_time"), timeframe)[0])
    key = K.local_trading_date(F.col("open_time"), timeframe.convention)
    return bars.withColumn("bucket", K.week_key(key) if timeframe.weekly else key)


def _bounds(df: DataFrame, timeframe: Timeframe) -> DataFrame:
    """Open and close times of buckets."""
    if timeframe.delta is not None:
        return df.withColumns({"open_time": F.col("bucket"), "close_time": F.col("bucket") + F.expr(f"interval {timeframe.minutes} minutes")})
    start = lambda d: K.trading_period_start(d, timeframe.convention)
    return df.withColumns({"open_time": start(F.col("bucket")), "close_time": start(F.date_add("bucket", 7 if timeframe.weekly else 1))})


def resample(bars: DataFrame, timeframe: Timeframe, confirmed: bool = True) -> DataFrame:
    """Bars of ``timeframe``, one shuffle by symbol and bucket. Buckets without a source bar give none.

    ``confirmed`` keeps the bars that lie whole within the source's span (its first open to its last close, by
    symbol), as the first and last bucket may lack a part. Bars inside may still have holes.
    """
    if timeframe is Timeframe.M1:
        raise ValueError("1m is the source, not a target")
    require_ntz(bars, "open_time", "close_time")
    ends = lambda f, x: f(x, "open_time")
    aggs = [F.sum("volume").alias("volume")]
    for s in ("bid", "ask"):
        aggs += [ends(F.min_by, f"{s}_open").alias(f"{s}_open"), F.max(f"{s}_high").alias(f"{s}_high"), F.min(f"{s}_low").alias(f"{s}_low"), ends(F.max_by, f"{s}_close").alias(f"{s}_close")]
    out = _bounds(_keyed(bars, timeframe).groupBy("symbol", "bucket").agg(*aggs), timeframe).select("symbol", *BAR_COLUMNS)
    return confirmed_only(out, spans(bars)) if confirmed else out


def spans(bars: DataFrame) -> DataFrame:
    """symbol, from, to: what time each symbol's bars span."""
    return bars.groupBy("symbol").agg(F.min("open_time").alias("from"), F.max("close_time").alias("to"))


def confirmed_only(derived: DataFrame, source: DataFrame) -> DataFrame:
    """The derived bars that lie whole within the ``spans`` of their source."""
    return derived.join(source, "symbol").where("open_time >= from AND close_time <= to").select("symbol", *BAR_COLUMNS)


def source_coverage(bars: DataFrame, derived: DataFrame, timeframe: Timeframe) -> DataFrame:
    """symbol, open_time, actual, expected, coverage of each derived bar.

    Actual: source bars inside it. Expected: minutes of it at which the market is open; none gives a null coverage.
    Both sides meet by bucket, an equi-join; the open minutes of each calendar bar are worked out once for all symbols.
    """
    have = _bounds(_keyed(bars, timeframe).groupBy("symbol", "bucket").agg(F.count("*").alias("actual")), timeframe)
    spans = materialized(derived.select("open_time", "close_time").distinct())  # few, and read three times
    due = with_open_minutes(spans, "open_time", "close_time", "expected").drop("close_time")
    out = derived.select("symbol", "open_time").join(have.select("symbol", "open_time", "actual"), ["symbol", "open_time"], "left").join(due, "open_time")
    out = out.withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return out.select("symbol", "open_time", "actual", "expected", F.try_divide("actual", "expected").alias("coverage"))


def coverage_summary(coverage: DataFrame, low: float = 0.9) -> DataFrame:
    """Bars, least and median coverage, and bars below ``low``, by symbol."""
    median = quantile(coverage, ["symbol"], "coverage", 0.5, "median_coverage")
    return coverage.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("coverage").alias("min_coverage"), F.count_if(F.col("coverage") < low).alias("low_bars")).join(median, "symbol", "left").select("symbol", "bars", "min_coverage", "median_coverage", "low_bars")
