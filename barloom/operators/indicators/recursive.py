"""Exponential recursions y = y + alpha (x - y) as window sums.

With q = 1 - alpha and u = alpha x (the first value: u = x), y[t] is the sum of q^(t - j) u[j]. Rows are cut into
blocks; inside a block that is q^k times a running sum of u q^-k, which all blocks do at once. What a block inherits is
a sum over the blocks before it with weights q^(B i), of which only the first few matter, as q^B is small: each block
sends its end to the next few. So the recursion needs no loop over a symbol's history, and no task sees more of it than blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators.registry import indicator, mid
from barloom.operators.spans import positioned, windowed

BLOCK = 256


def ewms(bars: DataFrame, keys: list[str], specs: list[tuple[str, Column, float, int]], skip: int = 0) -> DataFrame:
    """``bars`` with a column for each (out, value, alpha, least) of ``specs``: the recursion over the values, seeded by the first; null before ``least`` of them.

    Only the first ``skip`` rows of a series may have null values. ``bars`` may have ``_pos``, which stays.
    """
    if bad := [a for _, _, a, _ in specs if not 0 < a <= 1]:
        raise ValueError(f"alpha must be in (0, 1], not {bad[0]}")
    given = "_pos" in bars.columns
    df = bars if given else positioned(bars, keys)
    decays = {out: 1 - a for out, _, a, _ in specs if a < 1}
    size = min((max(1, min(BLOCK, int(600 / -math.log(q)))) for q in decays.values()), default=BLOCK)
    terms = max((math.ceil(-math.log(1e-18) / (-math.log(q) * size)) + 1 for q in decays.values()), default=1)
    df = df.withColumn("_n", F.col("_pos") + 1 - skip)
    df = df.withColumns({"_block": F.floor((F.col("_n") - 1) / size), "_k": F.pmod(F.col("_n") - 1, F.lit(size))})
    df = df.withColumns({f"_x_{out}": value for out, value, _, _ in specs})
    inside = Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    own = {}
    for out, _, alpha, _ in specs:
        if q := decays.get(out):
            u = F.when(F.col("_n") == 1, F.col(f"_x_{out}")).otherwise(alpha * F.col(f"_x_{out}"))
            own[f"_own_{out}"] = F.pow(F.lit(q), "_k") * F.sum(u * F.pow(F.lit(q), -F.col("_k"))).over(inside)
    df = df.withColumns(own) if own else df
    if decays:
        ends = df.where((F.col("_k") == size - 1) & (F.col("_n") > 0)).select(*keys, "_block", *own, F.explode(F.array(*map(F.lit, range(terms)))).alias("_i"))
        sums = [F.sum(F.col(f"_own_{out}") * F.pow(F.lit(q**size), "_i")).alias(f"_carry_{out}") for out, q in decays.items()]
        carried = ends.groupBy(*keys, (F.col("_block") + 1 + F.col("_i")).alias("_block")).agg(*sums)
        df = df.join(carried, [*keys, "_block"], "left")
    for out, _, _, least in specs:
        y = F.col(f"_x_{out}")
        if q := decays.get(out):
            y = F.col(f"_own_{out}") + F.coalesce(f"_carry_{out}", F.lit(0.0)) * F.pow(F.lit(q), F.col("_k") + 1)
        df = df.withColumn(out, F.when(F.col("_n") >= least, y))
    return df.select(*bars.columns, *(out for out, *_ in specs))


def ewm(bars: DataFrame, keys: list[str], value: Column, alpha: float, out: str, least: int = 1, skip: int = 0) -> DataFrame:
    """One recursion; see ``ewms``."""
    return ewms(bars, keys, [(out, value, alpha, least)], skip)


def _span(period: int) -> float:
    return 2 / (period + 1)


@indicator("ema", period=20)
def ema(bars, keys, period):
    return ewm(bars, keys, mid(), _span(period), "ema")


@indicator("rsi", period=14)
def rsi(bars, keys, period):
    """Wilder's index: 100 where nothing was lost, also on flat prices."""
    df = windowed(positioned(bars, keys), keys, lambda df, w: df.withColumn("_d", mid() - F.lag(mid()).over(w)), 1)
    part = lambda d: F.greatest(d, F.when(d.isNotNull(), 0.0))
    df = ewms(df, keys, [("_gain", part(F.col("_d")), 1 / period, period), ("_loss", part(-F.col("_d")), 1 / period, period)], skip=1)
    value = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_gain", "_loss")))
    return df.withColumn("rsi", F.when(F.col("_loss").isNotNull(), value)).drop("_d", "_gain", "_loss", "_pos")


@indicator("macd", "macd", "signal", "histogram", fast=12, slow=26, signal=9)
def macd(bars, keys, fast, slow, signal):
    df = ewms(positioned(bars, keys), keys, [("_fast", mid(), _span(fast), 1), ("_slow", mid(), _span(slow), 1)])
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm(df, keys, F.col("macd"), _span(signal), "signal")
    return df.withColumn("histogram", F.col("macd") - F.col("signal")).drop("_pos")


@indicator("atr", period=14)
def atr(bars, keys, period):
    """Wilder's mean of the true range; the first bar's is its own range."""

    def run(df, w):
        before = F.lag(mid()).over(w)
        return df.withColumn("_tr", F.greatest(mid("high") - mid("low"), F.abs(mid("high") - before), F.abs(mid("low") - before)))

    return ewm(windowed(positioned(bars, keys), keys, run, 1), keys, F.col("_tr"), 1 / period, "atr", period).drop("_tr", "_pos")
