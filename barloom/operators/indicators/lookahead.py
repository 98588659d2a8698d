"""Whether indicators look ahead: their values on a prefix of the bars must be those on all of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.indicators.registry import REGISTRY, compute
from barloom.operators.spans import positioned


def lookahead_violations(bars: DataFrame, names: Iterable[str] | None = None, cuts: Iterable[int] = (), tolerance: float = 1e-9) -> DataFrame:
    """indicator, output, symbol, cut, violations, first: bars of the prefix of ``cut`` bars whose value differs from that on all bars; none is a row less.

    ``names`` defaults to the whole registry. All prefixes are series of one table (symbol and cut are the keys), so an indicator runs once over all of
    them and once over the bars, whatever the number of cuts; work is the bars times the cuts. Values that differ by less than ``tolerance`` of their size
    are equal, and so are two nulls; a value on one side only is a violation.
    """
    cuts = sorted(set(cuts))
    if not cuts or cuts[0] < 1:
        raise ValueError("cuts must be positive")
    placed = positioned(bars, ["symbol"]).withColumnRenamed("_pos", "_place")
    within = F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("_place"))
    many = placed.withColumn("cut", F.explode(within)).drop("_place")
    out = None
    for name in sorted(REGISTRY if names is None else names):
        outputs = REGISTRY[name].outputs
        whole = compute(bars, name).select("symbol", "open_time", *(F.col(c).alias(f"_whole_{c}") for c in outputs))
        part = compute(many, name, keys=("symbol", "cut")).select("symbol", "cut", "open_time", *(F.col(c).alias(f"_part_{c}") for c in outputs))
        both = part.join(whole, ["symbol", "open_time"])
        pair = F.explode(F.array(*(F.struct(F.lit(c).alias("output"), F.col(f"_part_{c}").alias("a"), F.col(f"_whole_{c}").alias("b")) for c in outputs)))
        both = both.select("symbol", "cut", "open_time", pair.alias("x")).select("symbol", "cut", "open_time", "x.*")
        same = F.col("a").eqNullSafe(F.col("b")) | (F.abs(F.col("a") - F.col("b")) <= tolerance * F.greatest(F.lit(1.0), F.abs("b")))
        found = both.where(~F.coalesce(same, F.lit(False))).groupBy("output", "symbol", "cut").agg(F.count("*").alias("violations"), F.min("open_time").alias("first"))
        found = found.select(F.lit(name).alias("indicator"), "output", "symbol", F.col("cut").cast("long").alias("cut"), "violations", "first")
        out = found if out is None else out.unionByName(found)
    return out
