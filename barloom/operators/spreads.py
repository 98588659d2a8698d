"""Distributions of the spread by symbol and hour of the New York day, as stored sketches that merge.

A KLL sketch keeps a sample whose size depends on ``K`` and hardly on the data; merging sketches of days gives what one sketch of all their bars gives. The
rank of a quantile that it returns is off by at most ``rank_error`` with a probability of 99 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import caltime as K

SIZE = 200


def rank_error(size: int = SIZE) -> float:
    """The published error of a single quantile's rank, of sketches of ``size``."""
    return 2.296 / size**0.9021


def spread_sketches(bars: DataFrame, size: int = SIZE) -> DataFrame:
    """symbol, day (New York date), hour (0 to 23, New York), sketch, n, least, most of the closing spreads that are numbers: one small row a symbol and hour.

    What is stored by day; spreads of zero and below count like others.
    """
    local = K.local(F.col("open_time"), K.NEW_YORK)
    spread = bars.select("symbol", local.cast("date").alias("day"), F.hour(local).alias("hour"), (F.col("ask_close") - F.col("bid_close")).alias("spread"))
    spread = spread.where(F.col("spread").isNotNull() & ~F.isnan("spread"))
    return spread.groupBy("symbol", "day", "hour").agg(F.kll_sketch_agg_double("spread", F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.min("spread").alias("least"), F.max("spread").alias("most"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """One sketch for each of ``keys`` (such as symbol and hour), of all days."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def quantile_of(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def spread_quantiles(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """symbol, hour, n, least, most and a column for each quantile (``p50``, ``p90``, …) over all days of ``sketches``."""
    merged = merged_sketches(sketches, "symbol", "hour")
    return merged.select("symbol", "hour", "n", "least", "most", *(quantile_of(F.col("sketch"), q).alias(f"p{round(100 * q)}") for q in quantiles))
