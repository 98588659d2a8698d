"""Ticks that come late or twice, into minute bars of the lake: each batch rewrites the minutes that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.schema import Timeframe
from barloom.sources.lake import Lake
from barloom.sources.ticks import ticks_to_1m

TICKS = "symbol string, ts timestamp_ntz, id long, px double, spr double"


class LateTicks:
    """A ``foreachBatch`` target: ``stream.writeStream.foreachBatch(LateTicks(lake, path, "ticks"))``.

    A batch's ticks are stored under its number (a batch that comes again replaces itself); the minutes that it touches are built anew
    from all ticks stored for them and put into the lake, once for each symbol and batch number. So late ticks, ticks that come twice and batches
    that are replayed after a crash, wherever it was, lead to the bars that one batch of all ticks gives. Of ticks with the same symbol and id the one of the
    earliest batch counts. Ticks are stored by day, and a batch reads the days that it touches.
    """

    def __init__(self, lake: Lake, path: str, stream: str):
        self.lake, self.path, self.stream = lake, path.rstrip("/"), stream

    def __call__(self, ticks: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        minute = F.window("ts", "1 minute").start
        own = ticks.select("symbol", "ts", "id", "px", "spr", F.date_format("ts", "yyyy-MM-dd").alias("day"))
        own.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/batch={batch:012d}")
        new = self._stored(spark).where(F.col("batch") == batch)
        touched = new.select("symbol", "day", minute.alias("minute")).distinct()
        stored = self._stored(spark).where(F.col("batch") <= batch).withColumn("minute", minute).join(touched, ["symbol", "day", "minute"], "left_semi")
        first = stored.groupBy("symbol", "id").agg(F.min_by(F.struct("ts", "px", "spr"), "batch").alias("x")).select("symbol", "x.ts", "id", "x.px", "x.spr")
        bars = ticks_to_1m(first).persist()
        try:
            for row in bars.select("symbol").distinct().toLocalIterator():
                self.lake.upsert(row.symbol, Timeframe.M1, bars.where(F.col("symbol") == row.symbol), self.stream, batch)
        finally:
            bars.unpersist()

    def _stored(self, spark) -> DataFrame:
        return spark.read.schema(f"{TICKS}, batch long, day string").parquet(self.path)
