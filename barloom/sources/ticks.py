"""Ticks and minute bars. ``event_ticks`` and ``order_ticks`` read the driver's tables as ticks of four symbols each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import BAR_COLUMNS


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, id, px (Bid), spr (spread) from ``events``: dense, one month."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("double")
    return df.select(F.concat(F.lit("EV"), F.col("user_id") % 4).alias("symbol"), "ts", F.col("event_id").alias("id"), (F.lit(100.0) + F.col("value")).alias("px"), ((k + 1.0) / 1000.0).alias("spr"))


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from ``orders``: sparse, seven years with every change of the clocks."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    return df.select(F.concat(F.lit("OR"), F.col("o_custkey") % 4).alias("symbol"), ts.alias("ts"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000.0).alias("px"), ((F.col("o_custkey") % 7 + 1) / 1000.0).alias("spr"))


def ticks_to_1m(ticks: DataFrame) -> DataFrame:
    """Minute bars of ticks. Ask is Bid plus the minute's widest spread; ties in time are broken by id; volume counts ticks."""
    at = F.struct("ts", "id")
    g = ticks.groupBy("symbol", F.window("ts", "1 minute").start.alias("open_time"))
    g = g.agg(F.min_by("px", at).alias("bid_open"), F.max("px").alias("bid_high"), F.min("px").alias("bid_low"), F.max_by("px", at).alias("bid_close"), F.max("spr").alias("spr"), F.count("*").cast("double").alias("volume"))
    g = g.withColumns({f"ask_{f}": F.col(f"bid_{f}") + F.col("spr") for f in ("open", "high", "low", "close")})
    return g.withColumn("close_time", F.col("open_time") + F.expr("interval 1 minute")).select("symbol", *BAR_COLUMNS)
