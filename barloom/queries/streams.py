"""Streams, spread sketches and the look-ahead sweep over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.indicators import REGISTRY
from barloom.operators.indicators.lookahead import lookahead_violations
from barloom.operators.spreads import SIZE, quantile_of, rank_error, merged_sketches, spread_sketches
from barloom.queries.base import NY, TICKS_SQL, bars, scratch, ticks, with_bars, zone
from barloom.queries.bars import ALL
from barloom.queries.studies import SQL as STUDIES
from barloom.schema import BAR_COLUMNS, BAR_SCHEMA, Timeframe
from barloom.sources.lake import Lake
from barloom.streaming.indicators import STORE, stream_indicator
from barloom.streaming.late import TICKS, LateTicks


def _fed(df, path: str, part) -> None:
    """``df`` as files of a stream, one for each value of ``part``, in their order."""
    df = df.withColumn("_part", part).persist()
    for row in df.select("_part").distinct().orderBy("_part").collect():
        df.where(F.col("_part") == row[0]).drop("_part").coalesce(1).write.mode("append").parquet(path)
    df.unpersist()


def _streamed(name, digits):
    """An indicator of the bars of ``events``, a week a batch."""

    def run(spark, sf_dir):
        src, out, checkpoint = (scratch(spark) for _ in range(3))
        _fed(bars(spark, sf_dir), src, F.floor(F.unix_date(F.col("open_time").cast("date")) / 7))
        before = spark.conf.get(STORE[0])
        spark.conf.set(*STORE)
        try:
            stream = spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
            stream_indicator(stream, name).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
        finally:
            spark.conf.set(STORE[0], before)
        return spark.read.parquet(out).select("symbol", "open_time", F.round(name, digits).alias(name))

    return run


def late_ticks(spark, sf_dir):
    """Minute bars of ``events`` whose ticks come in three batches, each over the whole month, the second one twice."""
    src, root, stored, checkpoint = (scratch(spark) for _ in range(4))
    t = ticks(spark, sf_dir, "EV").select(*(c.split()[0] for c in TICKS.split(", ")))
    _fed(t, src, F.col("id") % 3)
    lake = Lake(spark, root)
    target = LateTicks(lake, stored, "ticks")
    stream = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(src)
    stream.writeStream.foreachBatch(target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    target(t.where("id % 3 = 1"), 1)
    out = None
    for row in t.select("symbol").distinct().orderBy("symbol").collect():
        part = lake._read(row.symbol, Timeframe.M1, lake.version(row.symbol, Timeframe.M1)).select("symbol", *BAR_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else bars(spark, sf_dir)


def spread_sketch(spark, sf_dir):
    """Merged daily sketches by symbol and hour: counts and ends are exact, and the ranks of quantiles, counted over all bars, are off by three rank errors at most."""
    b = bars(spark, sf_dir)
    merged = merged_sketches(spread_sketches(b), "symbol", "hour")
    merged = merged.select("symbol", "hour", "n", "least", "most", quantile_of(F.col("sketch"), 0.5).alias("p50"), quantile_of(F.col("sketch"), 0.9).alias("p90"))
    local = F.hour(F.convert_timezone(F.lit("UTC"), F.lit(NY), F.col("open_time")))
    both = b.select("symbol", local.alias("hour"), (F.col("ask_close") - F.col("bid_close")).alias("spread")).join(merged, ["symbol", "hour"])
    near = lambda v, q: (F.avg((F.col("spread") < F.col(v)).cast("double")) <= q + 3 * rank_error(SIZE)) & (F.avg((F.col("spread") <= F.col(v)).cast("double")) >= q - 3 * rank_error(SIZE))
    out = both.groupBy("symbol", F.col("hour").cast("long").alias("hour"), "n", "least", "most").agg(near("p50", 0.5).alias("p50_near"), near("p90", 0.9).alias("p90_near"))
    return out.withColumns({"least": F.round("least", 9), "most": F.round("most", 9)})


CUTS = (1, 15, 61, 200)


def lookahead_sweep(spark, sf_dir):
    """Each indicator of the registry on prefixes of all symbols: the bars compared, and the violations, of which there are none."""
    b = bars(spark, sf_dir)
    found = lookahead_violations(b, cuts=CUTS).groupBy("indicator").agg(F.sum("violations").alias("violations"))
    names = b.select("symbol").distinct().agg(F.count("*").alias("symbols")).select(F.explode(F.array(*map(F.lit, sorted(REGISTRY)))).alias("indicator"), "symbols")
    return names.join(found, "indicator", "left").select("indicator", "symbols", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"))


QUERIES = {
    "stream_ema": _streamed("ema", 7),
    "stream_rsi": _streamed("rsi", 6),
    "late_ticks": late_ticks,
    "spread_sketch": spread_sketch,
    "lookahead_sweep": lookahead_sweep,
}

_SPREADS = f"SELECT symbol, hour({zone('open_time', NY)}) AS hour, ask_close - bid_close AS spread FROM b"
SQL = {
    "stream_ema": STUDIES["ema"],
    "stream_rsi": STUDIES["rsi"],
    "late_ticks": f"{with_bars()} SELECT {ALL} FROM b",
    "spread_sketch": f"{with_bars()} SELECT symbol, hour::BIGINT AS hour, count(*)::BIGINT AS n, round(min(spread), 9) AS least, round(max(spread), 9) AS most, TRUE AS p50_near, TRUE AS p90_near FROM ({_SPREADS}) GROUP BY ALL",
    "lookahead_sweep": f"SELECT unnest({sorted(REGISTRY)}) AS indicator, count(DISTINCT symbol)::BIGINT AS symbols, 0::BIGINT AS violations FROM ({TICKS_SQL['EV']})",
}
