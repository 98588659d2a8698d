"""Tables for charts: the visible rows, session bands, overlays. Drawing is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.operators import indicators
from barloom.operators.spans import positioned

#: Rows a chart shows at most.
CHART_BARS = 1500


def tail(bars: DataFrame, n: int = CHART_BARS) -> DataFrame:
    """The last ``n`` rows of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.col("open_time").desc())
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def session_bands(bars: DataFrame) -> DataFrame:
    """symbol, session, start, stop of each run of bars in one session; OFF is left out.

    In a run, the bar's position among all bars and that among the bars of its session grow alike.
    """
    df = bars.select("symbol", "open_time", "close_time").withColumn("session", K.session_labels(F.col("open_time")))
    df = positioned(df, ["symbol"]).withColumnRenamed("_pos", "run").where("session <> 'OFF'")
    df = positioned(df, ["symbol", "session"]).withColumn("run", F.col("run") - F.col("_pos"))
    return df.groupBy("symbol", "session", "run").agg(F.min("open_time").alias("start"), F.max("close_time").alias("stop")).drop("run")


def overlay_tail(bars: DataFrame, name: str, n: int = CHART_BARS, **params) -> DataFrame:
    """The last ``n`` rows with an indicator that has seen all of history."""
    return tail(indicators.compute(bars, name, **params), n)


def candles(bars: DataFrame, trades: DataFrame | None = None) -> DataFrame:
    """symbol, open_time, close_time and mid prices; with ``trades`` also the marks at their bars, as arrays of prices in order of time.

    A trade has symbol, entry_time, entry_price, exit_time, exit_price and may have ``sl`` and ``tp``, whose levels (``stops``, ``targets``) are marked at
    the bars from its entry to its exit. Any number of trades leave a bar one row.
    """
    mid = {f: ((F.col(f"bid_{f}") + F.col(f"ask_{f}")) / 2).alias(f) for f in ("open", "high", "low", "close")}
    df = bars.select("symbol", "open_time", "close_time", *mid.values())
    if trades is None:
        return df
    minute = lambda c: F.date_trunc("minute", c).cast("timestamp_ntz")
    listed = lambda t, c: F.transform(F.sort_array(F.collect_list(F.struct(t, c))), lambda x: x[c])
    for mark in ("entry", "exit"):
        at = trades.select("symbol", minute(f"{mark}_time").alias("open_time"), F.col(f"{mark}_time").alias("t"), F.col(f"{mark}_price").alias("p"))
        df = df.join(at.where("p IS NOT NULL").groupBy("symbol", "open_time").agg(listed("t", "p").alias(mark)), ["symbol", "open_time"], "left")
    for level, name in (("sl", "stops"), ("tp", "targets")):
        if level in trades.columns:
            last = F.coalesce(minute("exit_time"), minute("entry_time"))
            held = trades.where(F.col(level).isNotNull()).select("symbol", F.col("entry_time").alias("t"), F.col(level).alias("p"), F.explode(F.sequence(minute("entry_time"), last, F.expr("interval 1 minute"))).alias("open_time"))
            df = df.join(held.groupBy("symbol", "open_time").agg(listed("t", "p").alias(name)), ["symbol", "open_time"], "left")
    return df
