"""Streams against batch: indicators over a restart, and bars of late, doubled and replayed ticks."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.indicators import compute
from barloom.schema import BAR_SCHEMA, Timeframe
from barloom.sources.lake import Lake
from barloom.sources.ticks import ticks_to_1m
from barloom.streaming.indicators import STORE, stream_indicator
from barloom.streaming.late import TICKS, LateTicks
from tests.helpers import minute_bars

END = datetime(2030, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def store(spark):
    old = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    yield
    spark.conf.set(STORE[0], old)


@pytest.mark.parametrize("name", ["ema", "rsi"])
def test_stream_equals_batch_over_a_restart(spark, tmp_path, store, name):
    x = np.random.default_rng(2).normal(0, 0.05, 240).cumsum() + 150
    x[150:] = np.maximum.accumulate(x[150:])
    bars = minute_bars(spark, "2026-01-05 21:00", 240, price=lambda i: float(x[i])).union(minute_bars(spark, "2026-01-06 00:30", 100, symbol="Y"))
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))

    def run():  # each run is a new query: all that it knows is in the checkpoint
        s = spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        q = stream_indicator(s, name).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        assert q.awaitTermination(120)

    cuts = [datetime(2026, 1, 5, 21), datetime(2026, 1, 5, 22, 7), datetime(2026, 1, 6, 0, 40), datetime(2026, 1, 7)]
    for a, b in zip(cuts, cuts[1:]):
        part = bars.where((F.col("open_time") >= F.lit(str(a)).cast("timestamp_ntz")) & (F.col("open_time") < F.lit(str(b)).cast("timestamp_ntz")))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(src)
        run()
    bars.where("minute(open_time) = 5").coalesce(1).write.mode("append").parquet(src)  # known bars once more
    run()
    got = {(r.symbol, r.open_time): r[name] for r in spark.read.parquet(out).collect()}
    want = {(r.symbol, r.open_time): r[name] for r in compute(bars, name).collect()}
    assert len(spark.read.parquet(out).collect()) == len(want) == 340 and got.keys() == want.keys()
    for k, v in want.items():
        assert (v is None) == (got[k] is None) and (v is None or got[k] == pytest.approx(v, rel=1e-10))


def test_only_recursions_are_streamed(spark):
    with pytest.raises(ValueError, match="not streamed"):
        stream_indicator(spark.createDataFrame([], BAR_SCHEMA), "sma")


def some_ticks():
    rng = random.Random(8)
    t0 = datetime(2025, 12, 31, 23, 58)
    out = [(rng.choice("XY"), t0 + timedelta(seconds=rng.randrange(240)), i, 100 + rng.random(), rng.choice([0.01, 0.02])) for i in range(300)]
    return out, [[t for t in out if t[2] % 3 == k] for k in range(3)]


def lake_rows(lake):
    return sorted(tuple(r) for s in "XY" for r in lake.load(s, Timeframe.M1, as_of=END).collect())


def test_late_doubled_and_replayed_ticks_give_the_batch_result(spark, tmp_path, monkeypatch):
    every, parts = some_ticks()
    lake = Lake(spark, str(tmp_path / "lake"))
    target = LateTicks(lake, str(tmp_path / "ticks"), "ticks")
    frame = lambda rows: spark.createDataFrame(rows, TICKS)
    want = sorted(tuple(r) for r in ticks_to_1m(frame(every)).collect())
    target(frame(parts[0]), 0)
    upsert = lake.upsert

    def fails_for_y(symbol, *args):
        if symbol == "Y":
            raise OSError("lost")
        return upsert(symbol, *args)

    monkeypatch.setattr(lake, "upsert", fails_for_y)
    with pytest.raises(OSError):  # X may be in by now
        target(frame(parts[1]), 1)
    monkeypatch.undo()
    target(frame(parts[1]), 1)
    target(frame(parts[2] + parts[0][:40]), 2)  # some come again
    assert lake_rows(lake) == want
    n = lake.versions("X", Timeframe.M1)
    target(frame(parts[1]), 1)
    target(frame(parts[2] + parts[0][:40]), 2)
    assert lake_rows(lake) == want and lake.versions("X", Timeframe.M1) == n


def test_as_a_stream(spark, tmp_path):
    every, parts = some_ticks()
    lake, src = Lake(spark, str(tmp_path / "lake")), str(tmp_path / "src")
    target = LateTicks(lake, str(tmp_path / "ticks"), "ticks")
    for p in parts:
        spark.createDataFrame(p, TICKS).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(src)
        q = s.writeStream.foreachBatch(target).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert lake_rows(lake) == sorted(tuple(r) for r in ticks_to_1m(spark.createDataFrame(every, TICKS)).collect())
    assert lake.version("X", Timeframe.M1)["batches"] == {"ticks": 2}
