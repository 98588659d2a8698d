"""The record store: append-only JSON tables of fetched ranges, quality reports and openings of locked periods."""

from __future__ import annotations

import json
import math
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.caltime import ensure_utc_timestamp
from barloom.operators.intervals import merge_ranges
from barloom.sources.files import Files

#: Fields without which a payload is no quality report.
REPORT_FIELDS = ("symbol", "timeframe", "expected_bars", "actual_bars", "missing_bars", "longest_gap_minutes", "duplicate_count", "conflicting_count", "bad_spread_count", "wide_spread_count", "price_jump_count", "gaps")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The payload appended last for each key, by sequence and not by clock."""
    return rows.groupBy(*keys).agg(F.max_by("payload", "seq").alias("payload"))


def history(rows: DataFrame, *keys: str) -> DataFrame:
    """All payloads with their place in the order of insertion, from 1."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return rows.select(*keys, F.row_number().over(w).alias("place"), "payload")


def report_kind(payload: Column) -> Column:
    """What a payload is: none, quarantined, summary (a whole report; unknown fields do not matter), raw (anything else)."""
    found = F.json_object_keys(payload)
    lacks = F.size(F.array_except(F.array(*map(F.lit, REPORT_FIELDS)), F.coalesce(found, F.array().cast("array<string>"))))
    status = F.get_json_object(payload, "$.status")
    return F.when(payload.isNull(), "none").when(F.coalesce(status == "quarantined", F.lit(False)), "quarantined").when(lacks == 0, "summary").otherwise("raw")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.where(F.get_json_object("payload", "$.status") == "quarantined")


def json_safe(x):
    """``x`` as JSON can hold it: null for what is not finite, ISO 8601 for times, lists for tuples."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    return [json_safe(v) for v in x] if isinstance(x, (list, tuple)) else x


class Meta:
    """Appends rows of small tables under ``root``; ``seq`` orders them. Any number of writers: no row is lost, no ``seq`` is used twice."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    _KINDS = {
        "fetch_ranges": "seq long, symbol string, timeframe string, start string, stop string",
        "quality_reports": "seq long, symbol string, timeframe string, payload string",
        "coverage_reports": "seq long, symbol string, timeframe string, payload string",
        "oos_unlocks": "seq long, at string, period string, reason string",
    }

    def _table(self, name: str) -> DataFrame:
        if not self.files.names(f"{self.root}/{name}"):
            return self.spark.createDataFrame([], self._KINDS[name])
        return self.spark.read.schema(self._KINDS[name]).json(f"{self.root}/{name}")

    def _append(self, name: str, *values: str) -> int:
        """One row in a file of its own, named by its ``seq``: the first number that no other writer has taken. Returns it."""
        names = [c.split()[0] for c in self._KINDS[name].split(",")]
        seq = int((self.files.names(f"{self.root}/{name}") or ["0"])[-1].split(".")[0])
        while True:
            seq += 1
            if self.files.put_if_absent(f"{self.root}/{name}/{seq:012d}.json", json.dumps(dict(zip(names, (seq, *values), strict=True))) + "\n"):
                return seq

    def record_fetch(self, symbol: str, timeframe: str, start: datetime, stop: datetime) -> None:
        """Aware times only: what is stored is UTC."""
        self._append("fetch_ranges", symbol, timeframe, *(ensure_utc_timestamp(t).isoformat(sep=" ") for t in (start, stop)))

    def fetched_ranges(self, symbol: str, timeframe: str) -> list[tuple[datetime, datetime]]:
        df = self._table("fetch_ranges").where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
        df = df.select(F.col("symbol").alias("key"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "stop")))
        return [(r.start, r.stop) for r in merge_ranges(df).orderBy("start").collect()]

    def record_quality(self, symbol: str, timeframe: str, payload: dict, table: str = "quality_reports") -> None:
        self._append(table, symbol, timeframe, json.dumps(json_safe(payload), allow_nan=False))

    def _reports(self, symbol: str, timeframe: str, table: str) -> DataFrame:
        return self._table(table).where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))

    def latest_quality(self, symbol: str, timeframe: str, table: str = "quality_reports") -> dict | None:
        row = latest(self._reports(symbol, timeframe, table), "symbol", "timeframe").first()
        return None if row is None else json.loads(row.payload)

    def quality_history(self, symbol: str, timeframe: str, table: str = "quality_reports") -> list[dict]:
        return [json.loads(r.payload) for r in history(self._reports(symbol, timeframe, table), "symbol", "timeframe").orderBy("place").collect()]

    def record_oos_unlock(self, period: str, reason: str) -> None:
        if not period.strip() or not reason.strip():
            raise ValueError("period and reason must not be blank")
        self._append("oos_unlocks", datetime.now(timezone.utc).isoformat(), period, reason)

    def oos_unlocks(self) -> list[tuple[str, str]]:
        return [(r.period, r.reason) for r in self._table("oos_unlocks").orderBy("seq").collect()]
