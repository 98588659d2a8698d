"""Checks of a bar table: all rules counted in one pass, or the first broken one raised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.spans import positioned, windowed
from barloom.schema import BAR_COLUMNS, PRICES, VALUES, Timeframe, require_ntz

#: A calendar bar is no longer than this; a week with a change of the clock stays below.
LONGEST_DAYS = 8


def project_bars(df: DataFrame) -> DataFrame:
    """The bar columns (and symbol), prices and volume as doubles; further columns go, missing ones are an error."""
    missing = [c for c in BAR_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    require_ntz(df, "open_time", "close_time")
    head = ["symbol"] if "symbol" in df.columns else [F.lit("").alias("symbol")]
    return df.select(*head, "open_time", "close_time", *(F.col(c).cast("double").alias(c) for c in VALUES))


def rule_counts(df: DataFrame, timeframe: Timeframe) -> DataFrame:
    """One row: how many rows break each rule. Each row sees the next of its symbol, in blocks of rows; a null time comes first, and breaks its rules."""
    df = project_bars(df).withColumn("_series", F.coalesce(F.concat(F.lit("="), "symbol"), F.lit("")))
    following = lambda d, w: d.withColumn("next_open", F.lead("open_time").over(w))
    df = windowed(positioned(df, ["_series"], ("close_time",)), ["_series"], following, ahead=1)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    all_finite = finite(VALUES[0])
    for c in VALUES[1:]:
        all_finite = all_finite & finite(c)
    if timeframe.delta is not None:
        span = F.col("close_time") == F.col("open_time") + F.expr(f"interval {timeframe.minutes} minutes")
    else:
        span = (F.col("close_time") > F.col("open_time")) & (F.col("close_time") <= F.col("open_time") + F.expr(f"interval {LONGEST_DAYS} days"))
    crossed = F.greatest(*(F.col(b) - F.col(b.replace("bid", "ask")) for b in PRICES[:4])) > 0
    broken = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("next_open") == F.col("open_time")).alias("duplicate_open"),
        broken(span).alias("bad_span"),
        F.count_if(F.col("next_open") < F.col("close_time")).alias("overlap"),
        broken(all_finite).alias("not_finite"),
        F.count_if(all_finite & crossed).alias("ask_below_bid"),
    )


def validate_bars(df: DataFrame, timeframe: Timeframe) -> DataFrame:
    """The checked bars, or ValueError with the first broken rule. Runs one aggregation."""
    bars = project_bars(df)
    found = rule_counts(bars, timeframe).first().asDict()
    for rule in ("duplicate_open", "bad_span", "overlap", "not_finite", "ask_below_bid"):
        if found[rule]:
            raise ValueError(f"{timeframe.value} bars: {found[rule]} of {found['n_rows']} rows break {rule}")
    return bars


def combine_sides(bid: DataFrame, ask: DataFrame, timeframe: Timeframe) -> DataFrame:
    """Bars of two sides (symbol, open_time, open, high, low, close, volume): the times that both have; volume of the Bid."""
    if timeframe.delta is None:
        raise ValueError(f"{timeframe.value}: sides are combined for fixed lengths only")
    require_ntz(bid, "open_time", of="bid side: ")
    require_ntz(ask, "open_time", of="ask side: ")
    side = lambda df, name, *more: df.select("symbol", "open_time", *(F.col(f).alias(f"{name}_{f}") for f in ("open", "high", "low", "close")), *more)
    both = side(bid, "bid", "volume").join(side(ask, "ask"), ["symbol", "open_time"])
    return both.withColumn("close_time", F.col("open_time") + F.expr(f"interval {timeframe.minutes} minutes")).select("symbol", *BAR_COLUMNS)
