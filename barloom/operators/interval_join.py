"""Joins of points with intervals, as equi-joins on bins of time, and what intervals cut out of a series.

An interval's level is the first power of two of ``GRAIN`` seconds that is not below its length, so it touches two bins of its level at most,
however long it is; a point has one bin at each level that occurs. Both meet on (keys, level, bin) and the bounds decide. Nothing is
compared with everything, and no row is laid out over the bins of a long interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.intervals import merge_ranges
from barloom.operators.opening import seconds_between, with_open_minutes
from barloom.schema import require_ntz

#: Seconds of the bins of each level; the last is longer than any time span.
GRAIN, LEVELS = 60, 40
WIDTHS = tuple(GRAIN << k for k in range(LEVELS))
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _bin(t: Column, level: Column) -> Column:
    return F.floor(seconds_between(F.expr(_EPOCH), t) / F.element_at(F.array(*map(F.lit, WIDTHS)), level + 1)).cast("long")


def _level(start: Column, stop: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w < seconds_between(start, stop)))


def levels_of(intervals: DataFrame, start: str = "start", stop: str = "stop") -> list[int]:
    """The levels that occur: at most ``LEVELS`` numbers."""
    return sorted(r.level for r in intervals.where(f"{start} < {stop}").select(_level(F.col(start), F.col(stop)).alias("level")).distinct().collect())


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str = "start", stop: str = "stop", how: str = "inner") -> DataFrame:
    """``points`` with the other columns of every interval of the same ``keys`` that holds them: start <= at < stop.

    ``how`` is inner (a row for each pair), left_semi or left_anti (points in some, in no interval). Intervals may overlap, leave holes and have any
    length; empty, reversed and null ones hold nothing, and a null time or key is in none. The columns of the two tables must differ but for the keys.
    """
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError(f"how must be inner, left_semi or left_anti, not {how!r}")
    require_ntz(points, at)
    require_ntz(intervals, start, stop)
    clash = set(points.columns) & set(intervals.columns) - set(keys)
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")
    used = levels_of(intervals, start, stop)
    level = _level(F.col(start), F.col(stop))
    binned = intervals.where(F.col(start) < F.col(stop)).withColumn("_level", level)
    last = F.col(stop) - F.expr("interval 1 microsecond")
    binned = binned.withColumn("_bin", F.explode(F.array_distinct(F.array(_bin(F.col(start), F.col("_level")), _bin(last, F.col("_level"))))))
    spread = points.withColumn("_level", F.explode(F.array(*map(F.lit, used)).cast("array<int>"))).withColumn("_bin", _bin(F.col(at), F.col("_level")))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))
    if how == "inner":
        return spread.join(binned, [*keys, "_level", "_bin"]).where(inside).drop("_level", "_bin")
    hit = spread.join(binned.select(*keys, "_level", "_bin", start, stop), [*keys, "_level", "_bin"]).where(inside).select(*keys, at).distinct()
    return points.join(hit, [*keys, at], how).select(*points.columns)


def interval_coverage(bars: DataFrame, intervals: DataFrame) -> DataFrame:
    """``intervals`` (symbol, start, stop) with actual, expected, coverage: bars that open inside, open minutes, and their share (null if none).

    Intervals may leave holes, whose bars belong to none, and overlap; of repeated ones each has a row. A share may exceed 1 where bars were made while the market was shut.
    """
    own = intervals.select("symbol", "start", "stop").distinct()
    have = points_in_intervals(bars.select("symbol", "open_time"), own, ["symbol"], "open_time").groupBy("symbol", "start", "stop").agg(F.count("*").alias("actual"))
    out = with_open_minutes(intervals.join(have, ["symbol", "start", "stop"], "left"), "start", "stop", "expected")
    out = out.withColumns({"actual": F.coalesce("actual", F.lit(0).cast("long")), "expected": F.greatest("expected", F.lit(0).cast("long"))})
    return out.withColumn("coverage", F.try_divide("actual", "expected"))


def segments(bars: DataFrame, bad: DataFrame) -> DataFrame:
    """``bars`` that no interval of ``bad`` (symbol, start, stop) touches, with ``segment``: how many bad stretches (overlapping ones are one) lie before.

    A bar is touched if any of its time, from open to close, is bad. Two bars have the same segment if no bad stretch begins between them,
    also where it holds no bar. Each bar looks up the last stretch that begins before its close, sorted within a month of its symbol; what a month begins
    with is carried from the months before, of which there is one row each.
    """
    w = Window.partitionBy("symbol").orderBy("start")
    bad = merge_ranges(bad.select(F.col("symbol").alias("key"), "start", "stop")).withColumnRenamed("key", "symbol")
    cuts = bad.select("symbol", F.col("start").alias("_t"), F.struct(F.row_number().over(w).cast("long").alias("n"), F.col("stop").alias("stop")).alias("_cut"))
    own = bars.select("symbol", F.col("close_time").alias("_t"), F.struct(*bars.columns).alias("_bar"))
    both = cuts.unionByName(own, allowMissingColumns=True).withColumn("_month", F.year("_t") * 12 + F.month("_t"))
    order = Window.partitionBy("symbol", "_month").orderBy("_t", F.col("_bar").isNull().cast("int"))  # a stretch that begins as a bar closes comes after it
    ends = both.groupBy("symbol", "_month").agg(F.max("_cut").alias("_end"))
    before = Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("symbol", "_month", F.max("_end").over(before).alias("_begin"))
    both = both.withColumn("_last", F.last("_cut", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = both.where("_bar IS NOT NULL").join(ends, ["symbol", "_month"]).withColumn("_cut", F.coalesce("_last", "_begin"))
    seen = seen.where(F.col("_cut").isNull() | (F.col("_cut.stop") <= F.col("_bar.open_time")))
    return seen.select("_bar.*", F.coalesce("_cut.n", F.lit(0).cast("long")).alias("segment"))
