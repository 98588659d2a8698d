"""Series in blocks: the same values whatever the blocks, across month borders too, and exact quantiles."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.operators import edge, quality, spans
from barloom.operators.asof import mtf_asof
from barloom.operators.chart import candles, session_bands
from barloom.operators.indicators import REGISTRY, compute
from barloom.operators.resample import resample
from barloom.plans.__main__ import main
from barloom.schema import Timeframe
from barloom.sources.lake import CachedLoads, Lake
from barloom.sources.meta import json_safe
from tests.helpers import minute_bars

MONTHS = "2026-01-31 22:00"  # two hours before a month's end


def walk(i):
    return 150 + ((i * 7919) % 101) / 50 - ((i * 31) % 17) / 20


@pytest.fixture(scope="module")
def bars(spark):
    b = minute_bars(spark, MONTHS, 300, price=walk, keep=lambda t: t.minute % 11 != 3)
    return b.union(minute_bars(spark, "2026-02-01 00:00", 100, "Y", price=lambda i: walk(i + 5)))


def found(df, *names):
    rows = df.select("symbol", "open_time", *names).collect()
    return {(r[0], r[1]): [None if x is None else round(x, 9) if isinstance(x, float) else x for x in r[2:]] for r in rows}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_indicators_do_not_depend_on_blocks(bars, monkeypatch, name):
    params = {"period": 5} if "period" in REGISTRY[name].defaults else {}
    whole = found(compute(bars, name, **params), *REGISTRY[name].outputs)
    monkeypatch.setattr(spans, "BLOCK", 7)
    assert found(compute(bars, name, **params), *REGISTRY[name].outputs) == whole and len(whole) == bars.count()


def test_a_series_is_cut_into_more_tasks_than_symbols(bars, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 7)
    run = lambda df, w: df.withColumn("block", F.col("_block"))
    out = spans.windowed(spans.positioned(bars, ["symbol"]), ["symbol"], run, 5)
    assert out.select("symbol", "block").distinct().count() > 40
    pos = {(r.symbol, r.open_time): r["_pos"] for r in out.collect()}
    for s in ("X", "Y"):
        own = sorted((t, p) for (x, t), p in pos.items() if x == s)
        assert [p for _, p in own] == list(range(len(own)))


def test_scans_do_not_depend_on_blocks(bars, monkeypatch):
    b = bars.withColumn("signal", F.minute("open_time") % 3 == 0)
    scan = lambda: {tuple(r[:3]): [None if x is None else round(x, 7) for x in r[3:]] for r in edge.scan(b, (1, 5, 30), group_by="session").collect()}
    whole = scan()
    monkeypatch.setattr(spans, "BLOCK", 31)
    monkeypatch.setattr(edge, "BLOCK", 31)
    assert scan() == whole
    total = {r.symbol: r.n_signals for r in edge.covered(b).collect()}
    assert all(v[0] == total[k[0]] for k, v in whole.items() if k[1] == "ALL")


def test_runs_and_last_values_cross_months(spark, bars, monkeypatch):
    bands = session_bands(bars.where("symbol = 'X'")).orderBy("start").collect()
    labels = [(r[0], r[1]) for r in bars.where("symbol = 'X'").select("open_time", K.session_labels(F.col("open_time"))).orderBy("open_time").collect()]
    want = [(t, s) for i, (t, s) in enumerate(labels) if s != "OFF" and (not i or labels[i - 1][1] != s)]
    assert [(r.start, r.session) for r in bands] == want
    got = found(mtf_asof(bars, resample(bars, Timeframe.H1), ["bid_close"]), "h_open_time")
    assert got["X", datetime(2026, 2, 1, 0, 1)] == [datetime(2026, 1, 31, 23)] and got["X", datetime(2026, 1, 31, 22, 30)] == [None]
    due = spark.createDataFrame([("X", datetime(2026, 1, 31, 23, m)) for m in range(50, 60)] + [("X", datetime(2026, 2, 1, 0, m)) for m in range(10)], "symbol string, open_time timestamp_ntz")
    runs = quality.gaps(bars.limit(0), due, Timeframe.M1).collect()
    assert [(r["from"].minute, r["to"].minute, r.missing_bars) for r in runs] == [(50, 9, 20)]


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.999, 1.0])
def test_quantile_is_exact(spark, q):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=3001), "b": rng.integers(0, 4, 2000).astype(float), "c": np.array([5.0]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("e", None)], "k string, v double").repartition(3)
    got = {r.k: r.x for r in spans.quantile(df, ["k"], "v", q, "x", accuracy=200).collect()}
    assert got == {k: pytest.approx(float(np.quantile(v, q)), abs=1e-12) for k, v in values.items()}


def test_first_row_in_input_order_stays(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 3)
    again = b.withColumn("volume", F.col("volume") - 5).coalesce(1)
    kept = quality.deduped(b.coalesce(1).union(again))
    assert {r.volume for r in kept.collect()} == {10.0}


def test_candles_keep_a_row_a_bar(spark):
    b = minute_bars(spark, "2026-01-05 07:00", 20)
    t = lambda m, s=0: datetime(2026, 1, 5, 7, m, s)
    trades = [("X", t(3, 40), 150.1, t(6), 151.0, 149.0, None), ("X", t(3, 20), 150.0, t(9), 151.5, 148.0, 153.0), ("X", t(12), 150.0, None, None, None, 154.0)]
    df = spark.createDataFrame(trades, "symbol string, entry_time timestamp_ntz, entry_price double, exit_time timestamp_ntz, exit_price double, sl double, tp double")
    got = {r.open_time.minute: r for r in candles(b, df).collect()}
    assert len(got) == candles(b, df).count() == 20
    assert got[3].entry == [150.0, 150.1] and got[6].exit == [151.0] and got[4].stops == [148.0, 149.0] and got[9].stops == [148.0]
    assert got[9].targets == [153.0] and got[12].targets == [154.0] and got[15].targets is None and got[0].entry is None


def test_payloads_hold_what_json_can():
    assert json_safe({"a": float("nan"), "b": (1.5, float("inf")), "t": datetime(2026, 1, 5)}) == {"a": None, "b": [1.5, None], "t": "2026-01-05T00:00:00"}


def test_skipped_and_repeated_hours_are_errors(spark):
    at = lambda wall: spark.range(1).select(K.localized(F.lit(wall).cast("timestamp_ntz"), K.NEW_YORK).alias("t")).first().t
    assert at("2026-03-08 17:00:00") == datetime(2026, 3, 8, 21)
    for wall in ("2026-03-08 02:30:00", "2026-11-01 01:30:00"):
        with pytest.raises(Exception, match="skips or repeats"):
            at(wall)


def test_command_line_ends_in_a_message(tmp_path, spark, capsys):
    assert main(["--settings", str(tmp_path / "none.toml"), "build"], spark) == 1
    assert "error:" in capsys.readouterr().err


def test_reports_of_windows_without_bars(spark):
    empty = minute_bars(spark, "2026-01-05 00:00", 1).limit(0)
    r = quality.check(empty, Timeframe.M1, datetime(2026, 1, 5), datetime(2026, 1, 5, 1), symbols=("X",)).collect()
    assert [(x.symbol, x.expected_bars, x.actual_bars, x.missing_bars, len(x.gaps)) for x in r] == [("X", 60, 0, 60, 1)]
    assert quality.check(empty, Timeframe.M1, datetime(2026, 1, 5), datetime(2026, 1, 5, 1)).count() == 0


def test_cached_loads(spark, tmp_path):
    lake, now = Lake(spark, str(tmp_path)), [0.0]
    lake.save("X", Timeframe.M1, minute_bars(spark, "2025-12-31 23:58", 5, price=lambda i: 150.0))
    assert lake.save("X", Timeframe.M1, minute_bars(spark, "2025-12-31 23:59", 6, price=lambda i: 150.0)) == 6 and lake.available_years("X", Timeframe.M1) == [2025, 2026]
    cached = CachedLoads(lake, entries=2, seconds=10, clock=lambda: now[0])
    ask = lambda m: cached.load("X", Timeframe.M1, as_of=datetime(2026, 1, 1, 0, m, tzinfo=timezone.utc))
    one = ask(1)
    assert one.count() == 3 and one.is_cached and ask(1) is one
    ask(2), ask(3)
    assert not one.is_cached and ask(1) is not one
    two = ask(1)
    now[0] = 11.0
    assert ask(1) is not two and not two.is_cached
    cached.clear()
    assert lake.load("X", Timeframe.M1, as_of=datetime(2027, 1, 1, tzinfo=timezone.utc)).count() == 7
