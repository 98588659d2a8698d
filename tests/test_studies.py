import math
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import edge as E
from barloom.operators.periods import Period, Settings, load_settings, visible_bars
from barloom.plans.build import build
from barloom.plans.ingest import FetchOutcome, fetch, uncovered
from barloom.schema import Timeframe as T
from barloom.sources.lake import Lake
from barloom.sources.meta import Meta
from tests.helpers import minute_bars

UTC = timezone.utc


def day(n, hour=0):
    return datetime(2026, 1, n, hour, tzinfo=UTC)


def test_returns_mean_and_median(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 8, price=lambda i: [0, 1, 3, 6, 10, 110, 110, 110][i] / 100 + 100)
    b = b.withColumn("signal", F.minute("open_time") < 5)
    r = E.scan(b, horizons=(1,), deduct_spread=False).first()
    assert (round(r["mean"], 6), round(r["median"], 6), r["n"]) == (22, 3, 5)
    assert r["std"] == pytest.approx(43.617656975128774)
    net = E.scan(b, horizons=(1,)).first()["mean"]
    assert net == pytest.approx(20)  # two pips of spread
    assert E.scan(b, horizons=(1,), direction="short").first()["mean"] == pytest.approx(-24)


def test_effective_n_is_the_double_sum(spark):
    rng = np.random.default_rng(3)
    pos = sorted(rng.choice(300, 120, replace=False).tolist())
    rows = [("X", "ALL", h, p, 0.0) for h in (1, 7, 60) for p in pos]
    got = {r.horizon: r.n_eff for r in E.effective_n(spark.createDataFrame(rows, "symbol string, grp string, horizon int, pos int, ret double")).collect()}
    for h in (1, 7, 60):
        assert got[h] == pytest.approx(120**2 / sum(max(0, 1 - abs(a - b) / h) for a in pos for b in pos), rel=1e-9)


def test_t_table(spark):
    v = spark.createDataFrame([(x,) for x in (0.5, 1.9, 2.0, 30.5, 31.0, 1e9)], "d double").select(E.t95(F.col("d"))).collect()
    assert [r[0] if r[0] is None else round(r[0], 4) for r in v] == [None, 12.706, 4.303, 2.042, 1.9758, 1.96]


def test_groups_without_signals_appear(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 1000).withColumn("signal", F.hour("open_time") == 1)
    r = {(x.grp, x.horizon): x.n for x in E.scan(b, horizons=(5,), group_by="session").collect()}
    assert r[("ALL", 5)] == r[("TOKYO", 5)] == 60 and r[("LONDON", 5)] == 0


@pytest.mark.parametrize("bad", [{"direction": "up"}, {"pip": 0}, {"group_by": "day"}, {"horizons": ()}, {"horizons": (0,)}])
def test_scan_guards(spark, bad):
    with pytest.raises(ValueError):
        E.scan(minute_bars(spark, "2026-01-05 00:00", 3).withColumn("signal", F.lit(True)), **bad)


def test_interval_is_wide_enough_for_overlapping_samples(spark):
    """Driftless random walks, a signal at every bar: the interval must hold 0 most of the time."""
    rows = []
    for seed in range(40):
        x = np.random.default_rng(seed).normal(0, 0.02, 500).cumsum() + 150
        for p in range(440):
            rows.append((str(seed), "ALL", 60, p, float(x[p + 60] - x[p])))
    r = E.horizon_stats(spark.createDataFrame(rows, "symbol string, grp string, horizon int, pos int, ret double")).collect()
    assert sum(not x.ci_lo <= 0 <= x.ci_hi for x in r) < 0.3 * len(r)


@pytest.fixture
def settings(tmp_path):
    return Settings("X", datetime(2026, 1, 1), str(tmp_path / "lake"), str(tmp_path / "meta"), {"open": Period("open", datetime(2026, 1, 5), datetime(2026, 1, 5)), "oos": Period("oos", datetime(2026, 1, 6), datetime(2026, 1, 7), True)})


def test_lock_gate(spark, settings):
    b = minute_bars(spark, "2026-01-05 20:00", 600).withColumn("signal", F.lit(True))
    meta = Meta(spark, settings.meta_path)
    assert settings.slice_bars(b, "open").count() == 240
    with pytest.raises(PermissionError):
        settings.slice_bars(b, "oos")
    for args in ({}, {"allow_locked": True}, {"allow_locked": True, "reason": " ", "meta": meta}, {"allow_locked": True, "reason": "r"}, {"allow_locked": True, "reason": "r", "meta": Meta(spark, "/elsewhere")}):
        with pytest.raises(PermissionError):
            E.scan_period(b, settings, "oos", **args)
    assert meta.oos_unlocks() == []
    assert E.scan_period(b, settings, "oos", True, "final check", meta, horizons=(1,)).first()["n"] == 359  # none crosses the end
    assert meta.oos_unlocks() == [("oos", "final check")]
    assert visible_bars(b, settings).count() == 240
    with pytest.raises(PermissionError):
        visible_bars(b, settings, meta=meta)
    assert visible_bars(b, settings, "look", meta).count() == 600
    with pytest.raises(KeyError):
        settings.period("none")


def test_scan_condition(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 200, price=lambda i: 150 + math.sin(i / 5))
    assert E.scan_condition(b, "rsi", "<", 30, horizons=(5,)).first()["n"] > 0
    for args in (("none", "<", 1), ("macd", "<", 1), ("rsi", "=", 1)):
        with pytest.raises(ValueError):
            E.scan_condition(b, *args)


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    assert lake.load("X", T.M1, as_of=day(9)).count() == 0
    b = minute_bars(spark, "2025-12-31 23:00", 120)
    lake.save("X", T.M1, b)
    lake.save("X", T.M1, b)
    assert lake.available_years("X", T.M1) == [2025, 2026]
    assert lake.load("X", T.M1, as_of=day(9)).count() == 120
    tokyo = datetime.fromisoformat("2026-01-01T09:30+09:00")
    assert lake.load("X", T.M1, as_of=tokyo).count() == 90 and lake.load("X", T.M1, as_of=tokyo, start=day(1)).count() == 30
    plan = lake.load("X", T.M1, as_of=tokyo)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(close_time), LessThanOrEqual(close_time" in plan and "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(TypeError):
        lake.load("X", T.M1)
    with pytest.raises(ValueError):
        lake.load("X", T.M1, as_of=datetime(2026, 1, 9))
    with pytest.raises(ValueError, match="differ"):
        lake.save("X", T.M1, b.withColumn("volume", F.when(F.year("open_time") == 2026, 11.0).otherwise(F.col("volume"))))
    assert lake.load("X", T.M1, as_of=day(9)).agg(F.sum("volume")).first()[0] == 1200
    for f in (lambda: lake.drop("X", T.M1), lambda: lake.replace("X", T.M1, b), lambda: lake.replace("X", T.H1, b.limit(0))):
        with pytest.raises(ValueError):
            f()


def test_build_and_drop(spark, settings):
    lake, meta = Lake(spark, settings.data_root), Meta(spark, settings.meta_path)
    lake.save("X", T.M1, minute_bars(spark, "2026-01-05 00:00", 600))
    done = build(settings, lake, as_of=day(9), meta=meta, timeframes=(T.H1, T.H4, T.D1_NY))
    assert done["1h"]["bars"] == 10 and done["4h"] == {"bars": 2, "min_coverage": 1.0, "median_coverage": 1.0, "low_bars": 0} and "1D_ny" not in done
    build(settings, lake, as_of=day(9), timeframes=(T.H1,))
    assert lake.load("X", T.H1, as_of=day(9)).count() == 10 and lake.drop("X", T.H1) == 1
    assert meta.latest_quality("X", "4h", "coverage_reports")["bars"] == 2


class Source:
    def __init__(self, spark, broken=()):
        self.spark, self.broken, self.asked = spark, broken, []

    def fetch(self, symbol, timeframe, start, end):
        self.asked.append(start.day)
        if start.day in self.broken:
            raise ValueError("bad data")
        return minute_bars(self.spark, start.strftime("%Y-%m-%d %H:%M"), 60)


def test_ingest_sets_bad_chunks_aside_and_retries(spark, settings):
    lake, meta = Lake(spark, settings.data_root), Meta(spark, settings.meta_path)
    first = fetch(Source(spark, {6}), lake, meta, "X", day(5), day(8), chunk_days=1)
    assert (first.requested, first.saved, first.quarantined, first.exit_code) == (3, 2, 1, 2)
    source = Source(spark)
    assert fetch(source, lake, meta, "X", day(5), day(8), chunk_days=1).exit_code == 0 and source.asked == [6]
    assert meta.fetched_ranges("X", "1m") == [(datetime(2026, 1, 5), datetime(2026, 1, 8))]
    kinds = [h.get("status", "report") for h in meta.quality_history("X", "1m")]
    assert kinds == ["quarantined", "report", "report"]


def test_outcomes_and_intervals():
    assert [FetchOutcome(*x).exit_code for x in ((0, 0, 0), (2, 0, 2), (2, 1, 1), (2, 2, 0))] == [0, 1, 2, 0]
    d = lambda n: datetime(2026, 1, n)
    assert uncovered([(d(2), d(3)), (d(5), d(9))], d(1), d(8)) == [(d(1), d(2)), (d(3), d(5))]
    assert uncovered([], d(1), d(2)) == [(d(1), d(2))]


def test_settings_file(tmp_path):
    p = tmp_path / "s.toml"
    p.write_text('symbol="X"\ndata_start=2015-01-01\ndata_root="r"\nmeta_path="m"\n[periods.oos]\nstart="2026-01-01"\nend="2026-02-01"\nlocked=true\n')
    assert load_settings(str(p)).period("oos") == Period("oos", datetime(2026, 1, 1), datetime(2026, 2, 1), True)
