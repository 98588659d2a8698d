"""Minute ticks to bars as a stream (an extension; batch rebuilds are the rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import BAR_COLUMNS


def stream_bars(ticks: DataFrame, length: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, id, px, spr), each emitted once, when the watermark passes its end.

    ``ts`` is cast to TIMESTAMP, as watermarks need, so the session time zone must be UTC. Later ticks are dropped.
    """
    at = F.struct("ts", "id")
    df = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = df.groupBy("symbol", F.window("ts", length).alias("w"))
    g = g.agg(F.min_by("px", at).alias("bid_open"), F.max("px").alias("bid_high"), F.min("px").alias("bid_low"), F.max_by("px", at).alias("bid_close"), F.max("spr").alias("spr"), F.count("*").cast("double").alias("volume"))
    g = g.withColumns({f"ask_{f}": F.col(f"bid_{f}") + F.col("spr") for f in ("open", "high", "low", "close")})
    return g.withColumns({"open_time": F.col("w.start").cast("timestamp_ntz"), "close_time": F.col("w.end").cast("timestamp_ntz")}).select("symbol", *BAR_COLUMNS)
