"""Where bars come from: a protocol, and a source of Bid and Ask sides in Parquet (the vendor's download is out of reach here)."""

from __future__ import annotations

from datetime import datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.caltime import ensure_utc_timestamp
from barloom.operators.validate import combine_sides, validate_bars
from barloom.schema import Timeframe


class BarSource(Protocol):
    def fetch(self, symbol: str, timeframe: Timeframe, start: datetime, end: datetime) -> DataFrame:
        """Bars that open in ``[start, end)``."""


class SideFiles:
    """Sides under ``root/{symbol}/{timeframe}/{bid,ask}``: open_time, open, high, low, close, volume."""

    TIMEFRAMES = (Timeframe.M1, Timeframe.M5, Timeframe.M15, Timeframe.H1, Timeframe.H4)

    def __init__(self, spark: SparkSession, root: str, symbols: tuple[str, ...] = ("USDJPY",)):
        self.spark, self.root, self.symbols = spark, root.rstrip("/"), symbols

    def fetch(self, symbol: str, timeframe: Timeframe, start: datetime, end: datetime) -> DataFrame:
        if symbol not in self.symbols:
            raise ValueError(f"unknown symbol {symbol!r}, not one of {self.symbols}")
        if timeframe not in self.TIMEFRAMES:
            raise ValueError(f"{timeframe.value} is not delivered")
        lo, hi = (F.lit(ensure_utc_timestamp(t).isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
        side = lambda s: self.spark.read.parquet(f"{self.root}/{symbol}/{timeframe.value}/{s}").where((F.col("open_time") >= lo) & (F.col("open_time") < hi)).withColumn("symbol", F.lit(symbol))
        return validate_bars(combine_sides(side("bid"), side("ask"), timeframe), timeframe)
