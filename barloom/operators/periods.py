"""Study periods and the lock on out-of-sample data. Whoever opens a locked period leaves a record first."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.caltime import ensure_utc_timestamp
from barloom.schema import require_ntz


@dataclass(frozen=True)
class Period:
    """Days from ``start`` to ``end``, both included, as naive UTC midnights."""

    name: str
    start: datetime
    end: datetime
    locked: bool = False

    def holds(self, t: Column) -> Column:
        ntz = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
        return (t >= ntz(self.start)) & (t < ntz(self.end + timedelta(days=1)))


@dataclass(frozen=True)
class Settings:
    symbol: str
    data_start: datetime
    data_root: str
    meta_path: str
    periods: dict[str, Period] = field(default_factory=dict)
    models: dict = field(default_factory=dict)

    def period(self, name: str) -> Period:
        if name not in self.periods:
            raise KeyError(f"unknown period {name!r}, not one of {sorted(self.periods)}")
        return self.periods[name]

    def slice_bars(self, bars: DataFrame, name: str, allow_locked: bool = False) -> DataFrame:
        p = self.period(name)
        if p.locked and not allow_locked:
            raise PermissionError(f"period {name!r} is locked: go through scan_period with allow_locked, a reason and the record store")
        require_ntz(bars, "open_time")
        return bars.where(p.holds(F.col("open_time")))

    def locked_mask(self, t: Column) -> Column:
        """Whether a time is in any locked period."""
        mask = F.lit(False)
        for p in self.periods.values():
            if p.locked:
                mask = mask | p.holds(t)
        return mask


def _day(x) -> datetime:
    if isinstance(x, datetime):
        return x if x.tzinfo is None else ensure_utc_timestamp(x)
    return datetime.fromisoformat(str(x))


def load_settings(path: str) -> Settings:
    """Settings from a TOML file with ``symbol``, ``data_start``, ``data_root``, ``meta_path``, ``[periods.*]``, ``[models]``."""
    raw = tomllib.loads(Path(path).read_text())
    periods = {k: Period(k, _day(v["start"]), _day(v["end"]), bool(v.get("locked", False))) for k, v in raw.get("periods", {}).items()}
    return Settings(raw["symbol"], _day(raw["data_start"]), raw["data_root"], raw["meta_path"], periods, raw.get("models", {}))


def authorize_locked_access(settings: Settings, name: str, reason: str | None, meta) -> None:
    """The only gate to a locked period: a reason, and the record store of these settings, which gets a row at once."""
    if not reason or not reason.strip():
        raise PermissionError(f"period {name!r} is locked: say why it is opened")
    if meta is None or meta.root.rstrip("/") != settings.meta_path.rstrip("/"):
        raise PermissionError(f"period {name!r} is locked: its opening must be recorded in {settings.meta_path}")
    meta.record_oos_unlock(name, reason)


def visible_bars(bars: DataFrame, settings: Settings, reason: str | None = None, meta=None) -> DataFrame:
    """Bars that may be shown. Without locked rows all; with a reason or a store, all after the gate; else the unlocked rows."""
    locked = settings.locked_mask(F.col("open_time"))
    if reason is None and meta is None:
        return bars.where(~locked)
    shown = [p.name for p in settings.periods.values() if p.locked and not bars.where(p.holds(F.col("open_time"))).isEmpty()]
    for name in shown:
        authorize_locked_access(settings, name, reason, meta)
    return bars


def locked_count(bars: DataFrame, settings: Settings) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(settings.locked_mask(F.col("open_time"))).alias("locked_bars"))
