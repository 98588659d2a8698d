"""Quality of stored bars: duplicates, gaps against the market calendar, spreads, jumps, all by symbol."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.opening import due_slots, missing_runs, slots
from barloom.operators.spans import positioned, quantile as exact_quantile, windowed
from barloom.schema import BAR_COLUMNS, VALUES, Timeframe, require_ntz
from barloom.sources.shared import materialized

#: Gaps of this many minutes or more are holidays rather than faults, in summaries.
HOLIDAY_MINUTES = 1440


def _step(timeframe: Timeframe) -> Column:
    return F.expr(f"interval {timeframe.minutes} minutes")


def _ntz(t: datetime) -> Column:
    """A naive time as a literal that no session time zone moves."""
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def _times(bars: DataFrame, order: str | None = None) -> DataFrame:
    """symbol, open_time, n (rows), differs (whether they differ anywhere), x: the first row by the column ``order``, or in the order of the input's partitions and rows."""
    same = F.struct("close_time", *VALUES)
    bars = bars if order else bars.withColumn("_order", F.monotonically_increasing_id())
    first = F.struct(order or "_order", *BAR_COLUMNS[1:])
    return bars.groupBy("symbol", "open_time").agg(F.count("*").alias("n"), (F.min(same) != F.max(same)).alias("differs"), F.min(first).alias("x"))


def _dups(times: DataFrame) -> DataFrame:
    return times.groupBy("symbol").agg((F.sum("n") - F.count("*")).alias("duplicate_count"), F.count_if("differs").alias("conflicting_count"))


def _firsts(times: DataFrame) -> DataFrame:
    return times.select("symbol", "open_time", *(f"x.{c}" for c in BAR_COLUMNS[1:]))


def dup_counts(bars: DataFrame) -> DataFrame:
    """symbol, duplicate_count (rows beyond the first of a time), conflicting_count (times whose rows differ anywhere)."""
    return _dups(_times(bars))


def deduped(bars: DataFrame, order: str | None = None) -> DataFrame:
    """The first row of each time by the column ``order``; without one, the first in the order of the input's partitions and rows."""
    return _firsts(_times(bars, order))


def due(bars: DataFrame, timeframe: Timeframe, start: datetime | None = None, stop: datetime | None = None) -> DataFrame:
    """The slots in which the market is open, as ranges (``opening.due_slots``): steps from ``start`` (default: the symbol's first bar) to ``stop`` (its last bar's end)."""
    first = _ntz(start) if start else F.min("open_time")
    end = _ntz(stop) if stop else F.max("open_time") + _step(timeframe)
    return due_slots(bars.groupBy("symbol").agg(first.alias("start"), end.alias("stop")), timeframe.minutes)


def expected_bars(bars: DataFrame, timeframe: Timeframe, start: datetime | None = None, stop: datetime | None = None) -> DataFrame:
    """symbol, open_time of each slot that is ``due``."""
    return slots(due(bars, timeframe, start, stop), timeframe.minutes)


def gaps_due(bars: DataFrame, due: DataFrame, timeframe: Timeframe) -> DataFrame:
    """symbol, from, to (last missing slot), missing_bars, minutes of each run of slots that are ``due`` and have no bar."""
    return missing_runs(bars, due, timeframe.minutes)


def gaps(bars: DataFrame, expected: DataFrame, timeframe: Timeframe) -> DataFrame:
    """The same of any listed slots (symbol, open_time)."""
    minutes = timeframe.minutes
    missing = expected.join(bars.select("symbol", "open_time").distinct(), ["symbol", "open_time"], "left_anti")
    run = F.expr("open_time - make_dt_interval(0, 0, cast(_pos * %d as int))" % minutes)  # the same for neighbours
    runs = positioned(missing, ["symbol"]).groupBy("symbol", run.alias("run")).agg(F.min("open_time").alias("from"), F.max("open_time").alias("to"), F.count("*").alias("missing_bars"))
    return runs.select("symbol", "from", "to", "missing_bars", (F.col("missing_bars") * float(minutes)).alias("minutes"))


def bad_spread(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(F.col("ask_close") - F.col("bid_close") <= 0).alias("bad_spread_count"))


def _spread_limit(bars: DataFrame, quantile: float) -> DataFrame:
    """symbol, threshold: the quantile of positive spreads."""
    spread = F.col("ask_close") - F.col("bid_close")
    return exact_quantile(bars.select("symbol", spread.alias("spread")).where("spread > 0"), ["symbol"], "spread", quantile, "threshold")


def wide_spread(bars: DataFrame, quantile: float = 0.999) -> DataFrame:
    """Threshold (exact, interpolated quantile of positive spreads, 0 without any) and the bars above it."""
    spread = F.col("ask_close") - F.col("bid_close")
    both = bars.join(_spread_limit(bars, quantile), "symbol", "left")
    return both.groupBy("symbol").agg(F.coalesce(F.first("threshold", True), F.lit(0.0)).alias("threshold"), F.count_if(F.coalesce(spread > F.col("threshold"), F.lit(False))).alias("wide_spread_count"))


def with_jumps(bars: DataFrame, timeframe: Timeframe, multiple: float = 10.0, period: int = 14) -> DataFrame:
    """``bars`` with ``jump``: a close moved more than ``multiple`` mean ranges against the bar just before."""
    mid = (F.col("bid_close") + F.col("ask_close")) / 2
    span = F.abs(F.col("bid_high") - F.col("bid_low"))

    def run(df, w):
        last = w.rowsBetween(-(period - 1), 0)
        df = df.withColumns({"_mid": mid, "_range": F.when(F.count(span).over(last) == period, F.avg(span).over(last))})
        moved = F.abs(F.col("_mid") - F.lag("_mid").over(w)) > multiple * F.col("_range")
        adjacent = F.col("open_time") == F.lag("open_time").over(w) + _step(timeframe)
        return df.withColumn("jump", F.coalesce(moved & adjacent, F.lit(False))).drop("_mid", "_range")

    return windowed(bars, ["symbol"], run, period)


def price_jumps(bars: DataFrame, timeframe: Timeframe, multiple: float = 10.0) -> DataFrame:
    return with_jumps(bars, timeframe, multiple).groupBy("symbol").agg(F.count_if("jump").alias("price_jump_count"))


def check(bars: DataFrame, timeframe: Timeframe, start: datetime | None = None, stop: datetime | None = None, multiple: float = 10.0, quantile: float = 0.999, order: str | None = None, symbols: tuple[str, ...] = ()) -> DataFrame:
    """One report row for each symbol; ``gaps`` lists the missing runs. All but the duplicate counts see deduplicated bars.

    With a window (``start`` and ``stop``), each of ``symbols`` has a report even if it has no bars: all that was due is missing then. ``bars`` are read once, into
    a table in the shared folder, by time; all figures come from there.
    """
    if timeframe.delta is None:
        raise ValueError(f"{timeframe.value}: quality is defined for fixed lengths only")
    require_ntz(bars, "open_time", "close_time")
    times = materialized(_times(bars, order))
    one = _firsts(times)
    wanted = due(one, timeframe, start, stop)
    out = _dups(times)
    if symbols and start and stop:
        given = bars.sparkSession.createDataFrame([(s,) for s in symbols], "symbol string")
        others = given.join(times.select("symbol").distinct(), "symbol", "left_anti").select("symbol", _ntz(start).alias("start"), _ntz(stop).alias("stop"))
        wanted = wanted.union(due_slots(others, timeframe.minutes))
        out = out.join(given, "symbol", "full")
    wanted = materialized(wanted)  # a row for a symbol and week, read three times
    found = gaps_due(one, wanted, timeframe)
    text = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    item = F.struct(text("from").alias("from"), text("to").alias("to"), "missing_bars", "minutes")
    listed = found.groupBy("symbol").agg(F.sort_array(F.collect_list(item)).alias("gaps"), F.max("minutes").alias("longest_gap_minutes"), F.sum("missing_bars").alias("missing_bars"))
    spread = F.col("ask_close") - F.col("bid_close")
    limit = _spread_limit(one, quantile)
    seen = with_jumps(one, timeframe, multiple).join(limit, "symbol", "left").groupBy("symbol").agg(  # one pass for what each bar shows
        F.count_if(spread <= 0).alias("bad_spread_count"), F.first("threshold", True).alias("threshold"),
        F.count_if(F.coalesce(spread > F.col("threshold"), F.lit(False))).alias("wide_spread_count"), F.count_if("jump").alias("price_jump_count"),
    )
    for part in (wanted.groupBy("symbol").agg(F.sum(F.col("last") - F.col("first") + 1).alias("expected_bars")), listed, seen):
        out = out.join(part, "symbol", "left")
    counts = ("duplicate_count", "conflicting_count", "expected_bars", "missing_bars", "bad_spread_count", "wide_spread_count", "price_jump_count")
    zero = dict.fromkeys(counts, 0) | {"longest_gap_minutes": 0.0, "threshold": 0.0}
    out = out.fillna(zero).withColumn("actual_bars", F.col("expected_bars") - F.col("missing_bars"))  # slots that have a bar
    return out.withColumn("gaps", F.coalesce("gaps", F.array().cast("array<struct<from:string,to:string,missing_bars:bigint,minutes:double>>")))


def gap_summary(reports: DataFrame) -> DataFrame:
    """symbol, summary: coverage, number of gaps, how many are as long as holidays, the longest of the others."""
    long = F.size(F.filter("gaps", lambda g: g["minutes"] >= HOLIDAY_MINUTES))
    rest = F.coalesce(F.array_max(F.transform(F.filter("gaps", lambda g: g["minutes"] < HOLIDAY_MINUTES), lambda g: g["minutes"])), F.lit(0.0))
    share = F.coalesce(F.try_divide(100.0 * F.col("actual_bars"), "expected_bars"), F.lit(0.0))
    share = F.format_number(share, 2)  # rounds the double itself, half to even, as printf does; format_string rounds its shortest decimal, half up
    return reports.select("symbol", F.format_string("coverage %s%%, %d gaps (%d of a day or more, longest other %d min)", share, F.size("gaps"), long, rest.cast("long")).alias("summary"))
