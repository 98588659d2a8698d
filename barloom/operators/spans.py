"""Long series in blocks of rows: positions, windows with a halo, and exact quantiles, none of which need a task to see a whole series.

A row's position counts the rows of its series before it: the row's number in its month, plus the sizes of the months
before, which are few. Rows of ``BLOCK`` consecutive positions make a block. A window that looks ``back`` or ``ahead``
over a bounded number of rows runs within a block to which the nearest rows of the neighbouring blocks are added, and so
a series is cut into as many tasks as its length asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 50_000


def positioned(bars: DataFrame, keys: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """``bars`` with ``_pos``: the row's position in its series by ``open_time`` (null first), then ``ties``, from 0. ``keys`` must not be null."""
    df = bars.withColumn("_month", F.coalesce(F.year("open_time") * 12 + F.month("open_time"), F.lit(0)))
    sizes = df.groupBy(*keys, "_month").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_month", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(*keys, "_month").orderBy("open_time", *ties))
    df = df.withColumn("_number", number).join(sizes, [*keys, "_month"])
    return df.select(*bars.columns, (F.col("_number") - 1 + F.col("_offset")).alias("_pos"))


def block_of(place: Column, size: int) -> Column:
    return F.floor(place / size)


def in_blocks(df: DataFrame, back: Column | int, ahead: Column | int, size: int) -> DataFrame:
    """Rows with ``_pos``, once for each block (``_block``) that they are in or near; ``_own`` where they are in it.

    A row is seen by blocks of rows up to ``back`` positions after it and ``ahead`` before it, which must not be more than ``size``.
    """
    pos = F.col("_pos")
    near = F.array_distinct(F.array(block_of(pos, size), block_of(pos + back, size), block_of(pos - ahead, size)))
    df = df.withColumn("_block", F.explode(near))
    return df.withColumn("_own", F.col("_block") == block_of(pos, size))


def windowed(bars: DataFrame, keys: list[str], compute: Callable[[DataFrame, WindowSpec], DataFrame], back: int = 0, ahead: int = 0) -> DataFrame:
    """What ``compute`` (of rows and a window by position) makes of ``bars``; it may look ``back`` rows behind and ``ahead`` of each.

    Adds ``_pos`` to ``bars`` if they have none; what has it keeps it.
    """
    given = "_pos" in bars.columns
    df = in_blocks(bars if given else positioned(bars, keys), back, ahead, max(BLOCK, back + ahead))
    out = compute(df, Window.partitionBy(*keys, "_block").orderBy("_pos")).where("_own").drop("_block", "_own")
    return out if given else out.drop("_pos")


def quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str, accuracy: int = 10_000) -> DataFrame:
    """``keys`` and ``out``: the exact quantile, linear between neighbours, of the non-null values of each group.

    Approximate quantiles either side bracket the values that decide; only distinct ones in between are ranked.
    """
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    near = [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]
    bracket = df.groupBy(*keys).agg(F.percentile_approx("_v", near, accuracy).alias("_b"), F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    few = F.col("_n") <= accuracy  # too few for the bracket to reach the neighbours of the place
    low = F.when(few | F.lit(near[0] == 0), F.col("_least")).otherwise(F.col("_b")[0])
    high = F.when(few | F.lit(near[1] == 1), F.col("_most")).otherwise(F.col("_b")[1])
    bracket = bracket.select(*keys, "_n", low.alias("_low"), high.alias("_high"))
    both = df.join(bracket, keys)
    below = F.col("_v") < F.col("_low")
    counts = both.where(F.col("_v") <= F.col("_high")).groupBy(*keys, "_n", F.when(~below, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    upto = F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    place = q * (F.col("_n") - 1)
    ranked = counts.withColumns({"_upto": upto, "_place": place}).where("_v IS NOT NULL")
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))  # noqa: E731  the value of rank r, from 0
    part = ranked.groupBy(*keys).agg(at(F.floor("_place")).alias("_a"), at(F.ceil("_place")).alias("_z"), F.first("_place").alias("_place"))
    return part.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_place") - F.floor("_place"))).alias(out))
