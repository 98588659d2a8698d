"""The bar lake: Parquet by symbol, time frame and UTC year, readable through a point-in-time cursor only."""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.caltime import ensure_utc_timestamp
from barloom.operators.validate import project_bars, validate_bars
from barloom.schema import BAR_COLUMNS, BAR_SCHEMA, VALUES, Timeframe, empty_bars
from barloom.sources.files import Files


def merge_conflicts(bars: DataFrame) -> DataFrame:
    """symbol, open_time of times that have rows with different values."""
    differ = F.lit(False)
    for c in ("close_time", *VALUES):
        differ = differ | (F.min(c) != F.max(c))
    return bars.groupBy("symbol", "open_time").agg(differ.alias("differ")).where("differ").select("symbol", "open_time")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each symbol and time of both; rows that repeat one with the same values collapse."""
    both = old.unionByName(new)
    first = F.min(F.struct(*BAR_COLUMNS[1:])).alias("x")
    return both.groupBy("symbol", "open_time").agg(first).select("symbol", "open_time", *(f"x.{c}" for c in BAR_COLUMNS[1:]))


class Conflict(RuntimeError):
    """Another writer published first, again and again."""


class Lake:
    """``root/bars/symbol=…/timeframe=…``: folders of bars by UTC year, and versions that say which of them count.

    A version is a small file, numbered from 1, that lists the folder of each year and the last batch of each stream that was upserted. Bars are written
    to new folders, which nobody reads; putting the next version is the one step that shows all of them, so a save of many years happens whole or not at
    all. A reader keeps the version that it found. Of two writers the second finds its number taken, and starts again from what the first left.
    """

    def __init__(self, spark: SparkSession, root: str, attempts: int = 10):
        self.spark, self.root, self.attempts, self.files = spark, root.rstrip("/"), attempts, Files(spark)

    def dir(self, symbol: str, timeframe: Timeframe) -> str:
        return f"{self.root}/bars/symbol={symbol}/timeframe={timeframe.value}"

    def versions(self, symbol: str, timeframe: Timeframe) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.dir(symbol, timeframe)}/_versions")]

    def version(self, symbol: str, timeframe: Timeframe, number: int | None = None) -> dict:
        """A version (default: the last): its number, ``years`` (the folder of each) and ``batches`` (the last of each stream). Number 0 is empty."""
        found = self.versions(symbol, timeframe)
        number = (found or [0])[-1] if number is None else number
        if number == 0:
            return {"number": 0, "years": {}, "batches": {}}
        if number not in found:
            raise ValueError(f"{symbol} {timeframe.value} has no version {number}")
        return {"number": number} | json.loads(self.files.read(self._version_path(symbol, timeframe, number)))

    def _version_path(self, symbol: str, timeframe: Timeframe, number: int) -> str:
        return f"{self.dir(symbol, timeframe)}/_versions/{number:012d}.json"

    def _publish(self, symbol: str, timeframe: Timeframe, base: dict, years: dict[str, str], batches: dict[str, int]) -> bool:
        text = json.dumps({"years": dict(sorted(years.items())), "batches": batches})
        return self.files.put_if_absent(self._version_path(symbol, timeframe, base["number"] + 1), text)

    def _read(self, symbol: str, timeframe: Timeframe, version: dict) -> DataFrame:
        if not version["years"]:
            return empty_bars(self.spark).withColumn("year", F.lit(0))
        path = self.dir(symbol, timeframe)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BAR_SCHEMA if f.name != "symbol")
        folders = [f"{path}/{folder}/year={year}" for year, folder in version["years"].items()]
        return self.spark.read.schema(f"{columns}, v string, year int").option("basePath", path).parquet(*folders).drop("v").withColumn("symbol", F.lit(symbol))

    def available_years(self, symbol: str, timeframe: Timeframe) -> list[int]:
        return sorted(map(int, self.version(symbol, timeframe)["years"]))

    def load(self, symbol: str, timeframe: Timeframe, *, as_of: datetime, start: datetime | None = None, version: int | None = None) -> DataFrame:
        """Bars closed by ``as_of`` (which has no default: nothing later may be seen), from ``start`` on, of the last version or a given one.

        The year bounds prune partitions; the time bounds reach the Parquet scan.
        """
        bars = self._read(symbol, timeframe, self.version(symbol, timeframe, version))
        return as_of_scan(bars, ensure_utc_timestamp(as_of), None if start is None else ensure_utc_timestamp(start)).select("symbol", *BAR_COLUMNS)

    def save(self, symbol: str, timeframe: Timeframe, bars: DataFrame) -> int:
        """Merge bars into the lake; returns how many were given. Bars that differ from stored ones are an error, and change nothing."""

        def both(old: DataFrame, new: DataFrame) -> DataFrame:
            clash = merge_conflicts(old.unionByName(new)).orderBy("open_time").limit(5).collect()
            if clash:
                raise ValueError(f"stored bars differ from new ones at {[str(r.open_time) for r in clash]}")
            return merged(old, new)

        return self._write(symbol, timeframe, bars, both)

    def upsert(self, symbol: str, timeframe: Timeframe, bars: DataFrame, stream: str, batch: int) -> int:
        """Put bars in place of stored ones of their times, once for each ``batch`` of a ``stream``: numbers up to the last one that came are known and left out (0)."""
        other = lambda old, new: old.join(new, ["symbol", "open_time"], "left_anti").select(*new.columns).unionByName(new)
        return self._write(symbol, timeframe, bars, other, (stream, batch))

    def _write(self, symbol: str, timeframe: Timeframe, bars: DataFrame, together, batch: tuple[str, int] | None = None) -> int:
        live = self.dir(symbol, timeframe)
        given = f"{live}/.given-{uuid.uuid4().hex}"
        known = lambda version: batch is not None and version["batches"].get(batch[0], -1) >= batch[1]
        if known(self.version(symbol, timeframe)):
            return 0
        try:
            project_bars(bars.withColumn("symbol", F.lit(symbol))).write.parquet(given)  # computed once; all that follows reads this
            new = validate_bars(self.spark.read.schema(BAR_SCHEMA).parquet(given), timeframe)
            sizes = {r.year: r["count"] for r in new.groupBy(F.year("open_time").alias("year")).count().collect()}
            if not sizes and batch is None:
                return 0
            for _ in range(self.attempts):
                base = self.version(symbol, timeframe)
                if known(base):
                    return 0
                years = {str(y) for y in sizes}
                touched = base | {"years": {y: f for y, f in base["years"].items() if y in years}}
                old = self._read(symbol, timeframe, touched).drop("year")
                folder = self._stage(symbol, timeframe, together(old.select(*new.columns), new)) if sizes else None
                batches = base["batches"] | (dict([batch]) if batch else {})
                if self._publish(symbol, timeframe, base, base["years"] | dict.fromkeys(years, folder), batches):
                    return sum(sizes.values())
                if folder:
                    self.files.delete(f"{live}/{folder}")
            raise Conflict(f"{symbol} {timeframe.value}: {self.attempts} versions of other writers came first")
        finally:
            self.files.delete(given)

    def _stage(self, symbol: str, timeframe: Timeframe, bars: DataFrame) -> str:
        """Writes bars by year to a folder of their own and checks them as they can be read; its name."""
        folder, live = f"v={uuid.uuid4().hex}", self.dir(symbol, timeframe)
        try:
            bars.drop("symbol").withColumn("year", F.year("open_time")).repartition("year").sortWithinPartitions("open_time").write.partitionBy("year").parquet(f"{live}/{folder}")
            validate_bars(self.spark.read.parquet(f"{live}/{folder}").withColumn("symbol", F.lit(symbol)), timeframe)
        except BaseException:
            self.files.delete(f"{live}/{folder}")
            raise
        return folder

    def drop(self, symbol: str, timeframe: Timeframe) -> int:
        """Publish a derived time frame without bars; returns how many years it had."""
        if timeframe is Timeframe.M1:
            raise ValueError("1m is the source and is not dropped")
        for _ in range(self.attempts):
            base = self.version(symbol, timeframe)
            if not base["years"] or self._publish(symbol, timeframe, base, {}, {}):
                return len(base["years"])
        raise Conflict(f"{symbol} {timeframe.value}: not dropped")

    def replace(self, symbol: str, timeframe: Timeframe, bars: DataFrame) -> None:
        """Put checked, non-empty bars in place of a derived time frame, whole."""
        if timeframe is Timeframe.M1:
            raise ValueError("1m is the source and is not replaced")
        bars = validate_bars(bars.withColumn("symbol", F.lit(symbol)), timeframe)
        if bars.isEmpty():
            raise ValueError("refusing to replace with no bars")
        folder, live = self._stage(symbol, timeframe, bars), self.dir(symbol, timeframe)
        years = {n.removeprefix("year="): folder for n in self.files.names(f"{live}/{folder}")}
        for _ in range(self.attempts):
            if self._publish(symbol, timeframe, self.version(symbol, timeframe), years, {}):
                return
        self.files.delete(f"{live}/{folder}")
        raise Conflict(f"{symbol} {timeframe.value}: not replaced")

    def vacuum(self, symbol: str, timeframe: Timeframe, keep: int = 10) -> int:
        """Delete all but the last ``keep`` versions and the folders that none of these lists; returns how many folders went.

        Not while a save runs, whose folder no version lists yet, nor while readers still use an older version.
        """
        if keep < 1:
            raise ValueError("the last version stays")
        live, found = self.dir(symbol, timeframe), self.versions(symbol, timeframe)
        used = {f for n in found[-keep:] for f in self.version(symbol, timeframe, n)["years"].values()}
        for n in found[:-keep]:
            self.files.delete(self._version_path(symbol, timeframe, n))
        gone = [n for n in self.files.names(live) if n.startswith("v=") and n not in used]
        for n in gone:
            self.files.delete(f"{live}/{n}")
        return len(gone)


class CachedLoads:
    """``Lake.load`` for readers that ask again, as a chart does: bars stay in the executors' memory, the last ``entries`` of them for ``seconds``."""

    def __init__(self, lake: Lake, entries: int = 8, seconds: float = 600.0, clock=time.monotonic):
        self.lake, self.entries, self.seconds, self.clock = lake, entries, seconds, clock
        self._held: dict[tuple, tuple[float, DataFrame]] = {}

    def load(self, symbol: str, timeframe: Timeframe, *, as_of: datetime, start: datetime | None = None) -> DataFrame:
        key, now = (symbol, timeframe, as_of, start), self.clock()
        for old in [k for k, (at, _) in self._held.items() if now - at >= self.seconds]:
            self._held.pop(old)[1].unpersist()
        if key not in self._held:
            self._held[key] = now, self.lake.load(symbol, timeframe, as_of=as_of, start=start).cache()
            while len(self._held) > self.entries:
                self._held.pop(next(iter(self._held)))[1].unpersist()
        return self._held[key][1]

    def clear(self) -> None:
        """Forget everything, as after a save."""
        while self._held:
            self._held.popitem()[1][1].unpersist()


def _ntz(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def as_of_scan(bars: DataFrame, as_of: datetime, start: datetime | None = None) -> DataFrame:
    """Bars with ``year`` as a point-in-time reader sees them."""
    df = bars.where((F.col("year") <= as_of.year) & (F.col("close_time") <= _ntz(as_of)))
    return df if start is None else df.where((F.col("year") >= start.year) & (F.col("open_time") >= _ntz(start)))
