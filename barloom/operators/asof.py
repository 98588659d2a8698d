"""As-of join of time frames: each bar gets the last bar of a higher frame that had closed by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mtf_asof(bars: DataFrame, higher: DataFrame, columns: list[str], prefix: str = "h_") -> DataFrame:
    """``bars`` with ``prefix`` + column of the higher bar with the latest close at or before this bar's open.

    One union, sorted within each month, and a running last value there; what a month begins with is the last value of the
    months before, of which there is one row each. No range join, and no task sees more than a month of a symbol.
    """
    names = [f"{prefix}{c}" for c in ("open_time", *columns)]
    value = F.struct(*(F.col(c).alias(n) for c, n in zip(("open_time", *columns), names, strict=True)))
    h = higher.select("symbol", F.col("close_time").alias("_t"), F.lit(0).alias("_side"), value.alias("_h"))
    b = bars.select("symbol", F.col("open_time").alias("_t"), F.lit(1).alias("_side"), F.struct(*bars.columns).alias("_b"))
    both = h.unionByName(b, allowMissingColumns=True).withColumn("_month", F.year("_t") * 12 + F.month("_t"))
    w = Window.partitionBy("symbol", "_month").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    months = both.groupBy("symbol", "_month").agg(F.max_by("_h", F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
    before = Window.partitionBy("symbol").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("symbol", "_month", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
    both = both.withColumn("_last", F.last("_h", ignorenulls=True).over(w)).where("_side = 1").join(months, ["symbol", "_month"])
    return both.select("_b.*", *(F.coalesce("_last", "_begin")[n].alias(n) for n in names))
