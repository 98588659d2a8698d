"""The bar table: one row for a symbol and an interval, Bid and Ask prices, times as UTC wall clock without zone."""

from __future__ import annotations

from datetime import timedelta
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Names of columns, time frames and sessions, and the lengths of time frames, are those of the data model.
FIELDS = ("open", "high", "low", "close")
PRICES = tuple(f"{side}_{f}" for side in ("bid", "ask") for f in FIELDS)
VALUES = (*PRICES, "volume")
BAR_COLUMNS = ("open_time", "close_time", *VALUES)

BAR_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("open_time", T.TimestampNTZType()),
        T.StructField("close_time", T.TimestampNTZType()),
        *(T.StructField(c, T.DoubleType()) for c in VALUES),
    ]
)


class Timeframe(Enum):
    """Bar lengths. Days and weeks follow a trading calendar and have no fixed length."""

    M1 = "1m"
    M5 = "5m"
    M15 = "15m"
    H1 = "1h"
    H4 = "4h"
    D1_NY = "1D_ny"
    D1_JST = "1D_jst"
    W1_NY = "1W_ny"
    W1_JST = "1W_jst"

    @property
    def delta(self) -> timedelta | None:
        minutes = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240}.get(self.value)
        return None if minutes is None else timedelta(minutes=minutes)

    @property
    def minutes(self) -> int:
        if self.delta is None:
            raise ValueError(f"{self.value} has no fixed length")
        return int(self.delta.total_seconds() // 60)

    @property
    def convention(self) -> str | None:
        return self.value.partition("_")[2] or None

    @property
    def weekly(self) -> bool:
        return self.value.startswith("1W")


DERIVED = tuple(t for t in Timeframe if t is not Timeframe.M1)


class Session(Enum):
    TOKYO = "TOKYO"
    LONDON = "LONDON"
    NEWYORK = "NEWYORK"
    LDN_NY_OVERLAP = "LDN_NY_OVERLAP"
    OFF = "OFF"


def empty_bars(spark: SparkSession) -> DataFrame:
    """No rows, the exact schema."""
    return spark.createDataFrame([], BAR_SCHEMA)


def require_ntz(df: DataFrame, *names: str, of: str = "") -> None:
    """Reject time columns with a session time zone: their wall clock would depend on who reads them. ``of`` names the table in the message."""
    for n in names:
        if not isinstance(df.schema[n].dataType, T.TimestampNTZType):
            raise ValueError(f"{of}{n} must be TIMESTAMP_NTZ in UTC, not {df.schema[n].dataType.simpleString()}; convert it first")
