"""Open time of the market as an index: a row for each New York day with when it opens and closes and the open minutes before it.

Open minutes between two times are then a difference of two look-ups, and the slots of a grid that are due are ranges of numbers
in the maximal open intervals; neither lays out the minutes of a span. The index has 366 rows a year, whatever the bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import caltime as K

#: Most days that an index may have, so that its rows can be sent to every task: about 540 years, some 10 MB.
MOST_DAYS = 200_000


def seconds_between(a: Column, b: Column) -> Column:
    """Exact seconds from ``a`` to ``b``, in whatever session time zone."""
    return (b - a).cast("interval second").cast("decimal(20,6)")


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def market_week(t: Column) -> Column:
    """Number of the week, from Saturday midnight New York on, when the market is shut."""
    return F.floor((F.unix_date(K.local(t, K.NEW_YORK).cast("date")) - 2) / 7)


def open_days(spans: DataFrame) -> DataFrame:
    """week, day, opens, closes, before: all New York days of the whole weeks that ``spans`` (start, stop) reach into.

    ``opens`` and ``closes`` are UTC, and equal where the market stays shut; ``before`` counts the open minutes of the days before.
    """
    day_of = lambda t: K.local(t, K.NEW_YORK).cast("date")
    ends = spans.agg(day_of(F.min("start")).alias("a"), day_of(F.max("stop")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    saturday = lambda d: F.date_sub(d, F.pmod(F.unix_date(d) - 2, F.lit(7)))
    ends = ends.select(saturday(F.col("a")).alias("a"), F.date_add(saturday(F.col("b")), 6).alias("b"))
    fits = F.when(F.datediff("b", "a") < MOST_DAYS, F.col("b")).otherwise(F.raise_error(F.lit(f"more than {MOST_DAYS} days")).cast("date"))
    days = ends.where("a <= b").select(F.explode(F.sequence("a", fits, F.expr("interval 1 day"))).alias("day"))
    shut = (F.weekday("day") == 5) | K._is_holiday(F.col("day"))
    opens = K.midnight(F.col("day")) + F.when(F.weekday("day") == 6, K.hours(17)).otherwise(K.hours(0))
    closes = K.midnight(F.col("day")) + F.when(shut, opens - K.midnight(F.col("day"))).when(F.weekday("day") == 4, K.hours(17)).otherwise(K.hours(24))
    days = days.select(F.floor((F.unix_date("day") - 2) / 7).alias("week"), "day", K.to_utc(opens, K.NEW_YORK).alias("opens"), K.to_utc(closes, K.NEW_YORK).alias("closes"))
    days = days.withColumn("_n", (seconds_between(F.col("opens"), F.col("closes")) / 60).cast("long"))
    weeks = days.groupBy("week").agg(F.sum("_n").alias("_w"))
    earlier = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, -1)  # a row a week: 5,000 in a century
    weeks = weeks.select("week", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w"))
    inside = Window.partitionBy("week").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_d", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(weeks), "week")
    return days.select("week", "day", "opens", "closes", (F.col("_w") + F.col("_d")).alias("before"))


def open_intervals(days: DataFrame) -> DataFrame:
    """week, opens, closes of each maximal stretch of open time; two never touch."""
    w = Window.partitionBy("week").orderBy("day")
    days = days.where("opens < closes").withColumn("_new", F.coalesce(F.lag("closes").over(w) != F.col("opens"), F.lit(True)).cast("int"))
    days = days.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return days.groupBy("week", "_run").agg(F.min("opens").alias("opens"), F.max("closes").alias("closes")).drop("_run")


def with_open_minutes(df: DataFrame, start: str, stop: str, out: str, days: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: how many whole minutes m (UTC, on the minute) with start <= m < stop the market is open; negative if they are in the wrong order.

    ``days`` is an index that reaches over all times, by default one of ``df``'s own; a null time gives null.
    """
    spans = df.select(F.least(start, stop).alias("start"), F.greatest(start, stop).alias("stop"))
    days = open_days(spans) if days is None else days
    minutes = lambda a, b: F.ceil(seconds_between(a, b) / 60).cast("long")
    for k, t in enumerate((start, stop)):
        index = F.broadcast(days.select(F.col("day").alias(f"_day{k}"), F.col("opens").alias("_o"), F.col("closes").alias("_c"), F.col("before").alias("_b")))
        df = df.withColumn(f"_day{k}", K.local(F.col(t), K.NEW_YORK).cast("date")).join(index, f"_day{k}", "left")
        upto = F.greatest(F.lit(0).cast("long"), minutes(F.col("_o"), F.least(F.col(t), F.col("_c"))))
        df = df.withColumn(f"_n{k}", F.col("_b") + upto).drop(f"_day{k}", "_o", "_c", "_b")
    return df.withColumn(out, F.col("_n1") - F.col("_n0")).drop("_n0", "_n1")


def due_slots(spans: DataFrame, minutes: int) -> DataFrame:
    """symbol, week, start, first, last: which slots of each span are due, as ranges of numbers, one for each open interval.

    ``spans`` has symbol, start, stop. Slot k begins at start + k * ``minutes``; it is due if it begins before stop and the market is open at its first or its last minute.
    Every shut stretch is longer than four hours, so slots of neighbouring intervals are never next to each other if ``minutes`` is at most 240.
    """
    if not 0 < minutes <= 240:
        raise ValueError(f"slots of 1 to 240 minutes, not {minutes}")
    spans = spans.where("start < stop").select("symbol", "start", "stop")
    open_ = open_intervals(open_days(spans)).withColumn("opens", F.col("opens") - F.expr(f"interval {minutes - 1} minutes"))
    weeks = spans.withColumn("week", F.explode(F.sequence(market_week(F.col("start")), market_week(F.col("stop")))))
    both = weeks.join(F.broadcast(open_), "week")
    number = lambda t: F.ceil(seconds_between(F.col("start"), t) / (60 * minutes)).cast("long")
    both = both.select("symbol", "week", "start", number(F.greatest("opens", "start")).alias("first"), (number(F.least("closes", "stop")) - 1).alias("last"))
    return both.where("first <= last")


def slots(due: DataFrame, minutes: int) -> DataFrame:
    """symbol, open_time of each slot of ``due_slots``; an open interval is at most five days long."""
    k = due.select("symbol", "start", F.explode(F.sequence("first", "last")).alias("k"))
    return k.select("symbol", (F.col("start") + _minutes(F.col("k") * minutes)).alias("open_time"))


def missing_runs(bars: DataFrame, due: DataFrame, minutes: int) -> DataFrame:
    """symbol, from, to (last missing slot), missing_bars, minutes of each run of slots of ``due`` that have no bar.

    Bars meet the open intervals of their week; within an interval, neighbours whose numbers differ by more than one enclose a run.
    """
    at = bars.select("symbol", "open_time").distinct().withColumn("week", market_week(F.col("open_time"))).join(due, ["symbol", "week"])
    apart = seconds_between(F.col("start"), F.col("open_time"))
    at = at.where(apart % (60 * minutes) == 0).withColumn("k", (apart / (60 * minutes)).cast("long")).where("k BETWEEN first AND last")
    keys = ["symbol", "week", "start", "first"]
    ends = due.select(*keys, F.explode(F.array(F.col("first") - 1, F.col("last") + 1)).alias("k"))
    w = Window.partitionBy(*keys).orderBy("k")
    runs = at.select(*keys, "k").unionByName(ends).withColumn("_p", F.lag("k").over(w)).where("k - _p > 1")
    time = lambda k: F.col("start") + _minutes(k * minutes)
    n = F.col("k") - F.col("_p") - 1
    return runs.select("symbol", time(F.col("_p") + 1).alias("from"), time(F.col("k") - 1).alias("to"), n.alias("missing_bars"), (n * float(minutes)).alias("minutes"))
