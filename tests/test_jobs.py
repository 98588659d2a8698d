from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom.operators.asof import mtf_asof
from barloom.operators.chart import candles, session_bands, tail
from barloom.operators.resample import resample
from barloom.plans.__main__ import main
from barloom.schema import Timeframe as T
from barloom.sources import meta as M
from barloom.streaming.bars import stream_bars
from tests.helpers import minute_bars


def test_command_line(spark, tmp_path, capsys):
    b = minute_bars(spark, "2026-01-05 00:00", 300)
    for s in ("bid", "ask"):
        b.select("open_time", *(F.col(f"{s}_{f}").alias(f) for f in ("open", "high", "low", "close")), "volume").write.parquet(str(tmp_path / "src/X/1m" / s))
    toml = tmp_path / "s.toml"
    toml.write_text(f'symbol="X"\ndata_start=2026-01-05\ndata_root="{tmp_path}/lake"\nmeta_path="{tmp_path}/meta"\n')
    base = ["--settings", str(toml)]
    assert main([*base, "ingest", "--source", str(tmp_path / "src"), "--end", "2026-01-05T05:00"], spark) == 0
    assert main([*base, "build", "--timeframe", "1h"], spark) == 0
    assert "'bars': 5" in capsys.readouterr().out


def test_as_of_join_sees_closed_bars_only(spark):
    b = minute_bars(spark, "2026-01-05 00:00", 130)
    got = {r.open_time.hour * 60 + r.open_time.minute: r.h_open_time for r in mtf_asof(b, resample(b, T.H1), ["bid_close"]).collect()}
    assert got[59] is None and got[60].hour == 0 and got[119].hour == 0 and got[120].hour == 1


def test_chart_tables(spark):
    b = minute_bars(spark, "2026-01-05 07:00", 120)
    assert [(r.session, r.start.hour, r.stop.hour) for r in session_bands(b).orderBy("start").collect()] == [("TOKYO", 7, 8), ("LONDON", 8, 9)]
    assert tail(b, 3).agg(F.min("open_time")).first()[0] == datetime(2026, 1, 5, 8, 57)
    trades = spark.createDataFrame([("X", datetime(2026, 1, 5, 7, 3, 20), 150.0, datetime(2026, 1, 5, 7, 9), 151.0)], "symbol string, entry_time timestamp_ntz, entry_price double, exit_time timestamp_ntz, exit_price double")
    assert candles(b, trades).where("entry IS NOT NULL OR exit IS NOT NULL").count() == 2


def test_report_kinds(spark):
    whole = "{" + ",".join(f'"{f}":1' for f in M.REPORT_FIELDS) + ',"more":2}'
    df = spark.createDataFrame([(None,), ('{"status":"quarantined"}',), (whole,), ('{"bars":1}',)], "p string")
    assert [r[0] for r in df.select(M.report_kind(F.col("p"))).collect()] == ["none", "quarantined", "summary", "raw"]


def test_record_store_refuses_blanks(spark, tmp_path):
    with pytest.raises(ValueError):
        M.Meta(spark, str(tmp_path)).record_oos_unlock("oos", "  ")


def test_stream_of_ticks(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        ticks = spark.createDataFrame([("X", datetime(2026, 1, 5, 0, m, 30), m, 100.0 + m, 0.5) for m in range(6)], "symbol string, ts timestamp_ntz, id long, px double, spr double")
        ticks.write.parquet(str(tmp_path / "ticks"))
        stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
        q = stream_bars(stream).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = [(r.open_time.minute, r.bid_close) for r in spark.table("bars").orderBy("open_time").collect()]
        assert got[:3] == [(0, 100.0), (1, 101.0), (2, 102.0)] and len(got) < 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_entry(spark):
    import os

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
