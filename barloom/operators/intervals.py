"""Interval algebra on rows (key, start, stop), half-open."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, key: str = "key") -> DataFrame:
    """Disjoint ranges that cover the same times; ranges that touch are one."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    seen = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = ranges.where("start < stop").withColumn("island", (F.col("start") > F.coalesce(seen, F.col("start") - F.expr("interval 1 second"))).cast("int"))
    df = df.withColumn("island", F.sum("island").over(w))
    return df.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def missing_ranges(covered: DataFrame, bounds: DataFrame, key: str = "key") -> DataFrame:
    """What of each row of ``bounds`` (key, lo, hi) no range of ``covered`` covers, clipped to it."""
    w = Window.partitionBy(key).orderBy("start")
    inside = merge_ranges(covered, key).join(bounds, key).where("stop > lo AND start < hi")
    inside = inside.select(key, F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop"), "lo", "hi")
    before = inside.select(key, F.coalesce(F.lag("stop").over(w), F.col("lo")).alias("start"), F.col("start").alias("stop"))
    after = inside.groupBy(key).agg(F.max("stop").alias("start"), F.first("hi").alias("stop"))
    whole = bounds.join(inside.select(key), key, "left_anti").select(key, F.col("lo").alias("start"), F.col("hi").alias("stop"))
    return before.unionByName(after).unionByName(whole).where("start < stop")


def chunks(ranges: DataFrame, days: int, key: str = "key") -> DataFrame:
    """Steps of ``days`` days through each range, the last one clipped."""
    step = F.expr(f"interval {days} days")
    df = ranges.where("start < stop").withColumn("at", F.explode(F.sequence("start", "stop", step))).where("at < stop")
    return df.select(key, F.col("at").alias("start"), F.least(F.col("at") + step, F.col("stop")).alias("stop"))


def iter_chunks(start: datetime, stop: datetime, step) -> list[tuple[datetime, datetime]]:
    """The same for one range on the driver, for jobs that work chunk by chunk."""
    out = []
    while start < stop:
        out.append((start, min(start + step, stop)))
        start += step
    return out
