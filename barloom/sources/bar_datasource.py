"""Bid and Ask sides in Parquet as a data source of Spark: ``spark.read.format("bar_sides")``.

A task reads one symbol's month, both sides, and joins them there; symbols and times choose the partitions before any task starts, and the row groups that a
task reads. Options: ``path`` (the folder of ``{symbol}/{timeframe}/{bid,ask}``), ``timeframe`` (default 1m), ``symbols`` (by commas; default: all that are
there), ``start`` and ``end`` (ISO, UTC; bars that open in between). These are options rather than pushed filters because Spark 4.1 keeps what filters chose
with the loaded table: one that is used twice, with a filter and without, would lack rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ads
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barloom.functions.caltime import ensure_utc_timestamp
from barloom.operators.validate import validate_bars
from barloom.schema import BAR_COLUMNS, BAR_SCHEMA, FIELDS, Timeframe

NAME = "bar_sides"
_TIME = pa.timestamp("us")
_ARROW = pa.schema([("symbol", pa.string()), ("open_time", _TIME), ("close_time", _TIME), *((c, pa.float64()) for c in BAR_COLUMNS[2:])])


@dataclass
class Month(InputPartition):
    symbol: str
    start: datetime
    stop: datetime


def _months(first: datetime, last: datetime) -> Iterator[tuple[datetime, datetime]]:
    """Calendar months from that of ``first`` to that of ``last``."""
    at = datetime(first.year, first.month, 1)
    while at <= last:
        after = datetime(at.year + at.month // 12, at.month % 12 + 1, 1)
        yield at, after
        at = after


class BarSidesReader(DataSourceReader):
    def __init__(self, path: str, timeframe: Timeframe, symbols: list[str] | None, start: datetime, stop: datetime):
        self.path, self.timeframe, self.symbols, self.start, self.stop = path.rstrip("/"), timeframe, symbols, start, stop

    def _store(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _side(self, symbol: str, side: str) -> ads.Dataset:
        store, root = self._store()
        return ads.dataset(f"{root}/{symbol}/{self.timeframe.value}/{side}", filesystem=store, format="parquet")

    def partitions(self) -> list[Month]:
        """Months that the files' own statistics say the Bid side reaches into, cut to the times asked for."""
        store, root = self._store()
        there = [i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name[0] not in "._"]
        out = []
        for symbol in sorted(set(there if self.symbols is None else self.symbols) & set(there)):
            months = set()
            for fragment in self._side(symbol, "bid").get_fragments():
                for group in fragment.row_groups:
                    known = group.statistics["open_time"]
                    months |= set(_months(known["min"], known["max"]))
            out += [Month(symbol, max(a, self.start), min(b, self.stop)) for a, b in sorted(months) if b > self.start and a < self.stop]
        return out

    def read(self, partition: Month | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's single task where there are no partitions
            return
        inside = (pc.field("open_time") >= pa.scalar(partition.start, _TIME)) & (pc.field("open_time") < pa.scalar(partition.stop, _TIME))

        def side(name, *more):
            table = self._side(partition.symbol, name).to_table(columns=["open_time", *FIELDS, *more], filter=inside)
            return table.rename_columns(["open_time", *(f"{name}_{f}" for f in FIELDS), *more]).set_column(0, "open_time", table.column("open_time").cast(_TIME))

        both = side("bid", "volume").join(side("ask"), "open_time", join_type="inner")
        times = both.column("open_time")
        both = both.append_column("close_time", pc.add(times, pa.scalar(self.timeframe.delta, pa.duration("us"))))
        both = both.append_column("symbol", pa.array([partition.symbol] * len(both), pa.string()))
        yield from both.select(_ARROW.names).cast(_ARROW).to_batches()


class BarSides(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return BAR_SCHEMA

    def reader(self, schema) -> BarSidesReader:
        timeframe = Timeframe(self.options.get("timeframe", "1m"))
        if timeframe.delta is None:
            raise ValueError(f"{timeframe.value}: sides have a fixed length")
        symbols = self.options.get("symbols")
        start, stop = (datetime.fromisoformat(x) if (x := self.options.get(n)) else default for n, default in (("start", datetime.min), ("end", datetime.max)))
        return BarSidesReader(self.options["path"], timeframe, symbols.split(",") if symbols else None, start, stop)


def read_sides(spark: SparkSession, path: str, timeframe: Timeframe = Timeframe.M1, symbols: tuple[str, ...] = (), start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Bars of the sides below ``path`` that open in ``[start, end)`` (aware times), lazily."""
    spark.dataSource.register(BarSides)
    options = {"path": path, "timeframe": timeframe.value}
    options |= {"symbols": ",".join(symbols)} if symbols else {}
    options |= {n: ensure_utc_timestamp(t).isoformat() for n, t in (("start", start), ("end", end)) if t is not None}
    return spark.read.format(NAME).options(**options).load()


class Sides:
    """The data source as a ``BarSource``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def fetch(self, symbol: str, timeframe: Timeframe, start: datetime, end: datetime) -> DataFrame:
        return validate_bars(read_sides(self.spark, self.path, timeframe, (symbol,), start, end), timeframe)
