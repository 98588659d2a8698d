"""The build job: all derived time frames from stored minute bars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.resample import confirmed_only, coverage_summary, resample, source_coverage, spans
from barloom.schema import DERIVED, Timeframe
from barloom.sources.shared import materialized


def _finer(timeframe: Timeframe, timeframes) -> Timeframe | None:
    """The shortest of the fixed ``timeframes`` if it divides ``timeframe``; calendar days and weeks begin on a full hour."""
    whole = timeframe.minutes if timeframe.delta is not None else 60
    least = min((t for t in timeframes if t.delta is not None), key=lambda t: t.minutes, default=None)
    return least if least is not None and least is not timeframe and whole % least.minutes == 0 else None


def derived(bars: DataFrame, timeframes=DERIVED) -> dict[Timeframe, DataFrame]:
    """Confirmed bars of each time frame. All are built from the shortest where that divides them.

    The shortest is written to the shared folder at once, so ``bars`` are read twice in all: for it, and for what time they span.
    """
    whole: dict[Timeframe, DataFrame] = {}
    for t in sorted(timeframes, key=lambda t: (t.delta is None, t.minutes if t.delta is not None else 0)):
        finer = _finer(t, whole)
        part = resample(whole[finer] if finer else bars, t, confirmed=False)
        whole[t] = part if whole or len(timeframes) == 1 else materialized(part)
    source = materialized(spans(bars)) if len(timeframes) > 1 else spans(bars)
    return {t: confirmed_only(whole[t], source) for t in timeframes}


def all_timeframes(bars: DataFrame, timeframes=DERIVED) -> DataFrame:
    """Bars of every time frame in one table, with ``timeframe``."""
    out = None
    for t, part in derived(bars, timeframes).items():
        part = part.withColumn("timeframe", F.lit(t.value))
        out = part if out is None else out.unionByName(part)
    return out


def build(settings, lake, *, as_of: datetime, meta=None, timeframes: tuple[Timeframe, ...] = DERIVED) -> dict[str, dict]:
    """Rebuild each time frame from the minute bars known at ``as_of``, whole, never merged; record its coverage.

    Returns the coverage figures by time frame; a frame without bars is skipped.
    """
    source = lake.load(settings.symbol, Timeframe.M1, as_of=as_of).cache()
    out = {}
    try:
        for t, bars in derived(source, timeframes).items():
            if bars.isEmpty():
                continue
            lake.replace(settings.symbol, t, bars)
            row = coverage_summary(source_coverage(source, bars, t)).first().asDict()
            out[t.value] = {k: v for k, v in row.items() if k != "symbol"}
            if meta is not None:
                meta.record_quality(settings.symbol, t.value, out[t.value], table="coverage_reports")
    finally:
        source.unpersist()
    return out
