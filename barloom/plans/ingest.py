"""The ingest job: fetch what is missing, chunk by chunk; bad chunks are set aside and tried again next time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from barloom.functions.caltime import ensure_utc_timestamp
from barloom.operators.intervals import iter_chunks
from barloom.operators.quality import check
from barloom.schema import Timeframe


@dataclass
class FetchOutcome:
    requested: int = 0
    saved: int = 0
    quarantined: int = 0

    @property
    def ok(self) -> bool:
        return self.exit_code == 0

    @property
    def exit_code(self) -> int:
        """0: done, or nothing to do; 1: asked for chunks, none saved; 2: some set aside."""
        if self.requested and not self.saved:
            return 1
        return 2 if self.quarantined else 0


def uncovered(have: list[tuple[datetime, datetime]], start: datetime, stop: datetime) -> list[tuple[datetime, datetime]]:
    """What of ``[start, stop)`` the ascending, disjoint ranges ``have`` leave open."""
    out, at = [], start
    for a, b in have:
        if a > at:
            out.append((at, min(a, stop)))
        at = max(at, b)
    if at < stop:
        out.append((at, stop))
    return [(a, b) for a, b in out if a < b]


def fetch(source, lake, meta, symbol: str, start: datetime, end: datetime, *, timeframe: Timeframe = Timeframe.M1, chunk_days: int = 30) -> FetchOutcome:
    """Fetch the parts of ``[start, end)`` not yet recorded. A ValueError sets a chunk aside; other errors end the job."""
    start, end = ensure_utc_timestamp(start), ensure_utc_timestamp(end)
    out = FetchOutcome()
    aware = lambda t: t.replace(tzinfo=timezone.utc)
    for a, b in uncovered(meta.fetched_ranges(symbol, timeframe.value), start, end):
        for lo, hi in iter_chunks(a, b, timedelta(days=chunk_days)):
            out.requested += 1
            bars = None
            try:
                bars = source.fetch(symbol, timeframe, aware(lo), aware(hi))
                lake.save(symbol, timeframe, bars)
            except ValueError as e:
                count = None if bars is None else bars.count()
                meta.record_quality(symbol, timeframe.value, {"status": "quarantined", "chunk_start": str(lo), "chunk_end": str(hi), "bar_count": count, "error": str(e)})
                out.quarantined += 1
                continue
            meta.record_fetch(symbol, timeframe.value, aware(lo), aware(hi))
            out.saved += 1
    stored = lake.load(symbol, timeframe, as_of=aware(end), start=aware(start))
    report = check(stored, timeframe, start, end, symbols=(symbol,)).first()  # a window without bars has one too
    if report is not None:
        meta.record_quality(symbol, timeframe.value, {"timeframe": timeframe.value} | report.asDict(recursive=True))
    return out
