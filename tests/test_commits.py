"""Saves happen whole or not at all, writers do not undo each other, and records are numbered once."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from barloom.schema import Timeframe as T
from barloom.sources.files import Files
from barloom.sources.lake import Conflict, Lake
from barloom.sources.meta import Meta
from tests.helpers import minute_bars

END = datetime(2030, 1, 1, tzinfo=timezone.utc)


def content(lake):
    return sorted(tuple(r) for r in lake.load("X", T.M1, as_of=END).collect())


def test_a_failure_between_two_years_leaves_the_old_version_whole(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    lake.save("X", T.M1, minute_bars(spark, "2025-12-31 23:50", 20))
    before, more = content(lake), minute_bars(spark, "2025-12-31 23:30", 60, price=lambda i: 150 + 0.01 * (i - 20))

    def one_year_only(symbol, timeframe, bars):
        bars.where(F.year("open_time") == 2025).drop("symbol").write.parquet(f"{lake.dir(symbol, timeframe)}/v=half/year=2025")
        raise OSError("the disk is full")

    monkeypatch.setattr(lake, "_stage", one_year_only)
    with pytest.raises(OSError, match="full"):
        lake.save("X", T.M1, more)
    assert content(lake) == before and lake.versions("X", T.M1) == [1]
    monkeypatch.undo()
    monkeypatch.setattr(lake.files, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("no route")))
    with pytest.raises(OSError, match="route"):
        lake.save("X", T.M1, more)
    assert content(lake) == before
    monkeypatch.undo()
    assert lake.save("X", T.M1, more) == 60 and len(content(lake)) == 60
    old = lake.load("X", T.M1, as_of=END, version=1)
    assert sorted(tuple(r) for r in old.collect()) == before


def test_readers_keep_their_version_until_vacuum(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    for k in range(4):
        lake.save("X", T.M1, minute_bars(spark, f"2026-01-05 00:0{k}", 1))
    reader = lake.load("X", T.M1, as_of=END)
    lake.save("X", T.M1, minute_bars(spark, "2026-01-05 00:09", 1))
    assert reader.count() == 4 and len(content(lake)) == 5
    assert lake.vacuum("X", T.M1, keep=2) == 3 and lake.versions("X", T.M1) == [4, 5] and reader.count() == 4 and len(content(lake)) == 5
    assert lake.vacuum("X", T.M1, keep=1) == 1 and len(content(lake)) == 5
    with pytest.raises(ValueError, match="no version"):
        lake.load("X", T.M1, as_of=END, version=2)
    with pytest.raises(ValueError):
        lake.vacuum("X", T.M1, keep=0)


def test_two_writers_of_one_year_both_get_in(spark, tmp_path, monkeypatch):
    one, two = Lake(spark, str(tmp_path)), Lake(spark, str(tmp_path))
    publish = Lake._publish

    def late(self, *args):
        if self is one and two.versions("X", T.M1) == []:
            two.save("X", T.M1, minute_bars(spark, "2026-01-05 01:00", 10))  # in between
        return publish(self, *args)

    monkeypatch.setattr(Lake, "_publish", late)
    assert one.save("X", T.M1, minute_bars(spark, "2026-01-05 00:00", 10)) == 10
    assert len(content(one)) == 20 and one.versions("X", T.M1) == [1, 2]
    monkeypatch.setattr(Lake, "_publish", lambda self, *a: False)
    with pytest.raises(Conflict):
        Lake(spark, str(tmp_path), attempts=2).save("X", T.M1, minute_bars(spark, "2026-01-05 02:00", 1))
    monkeypatch.undo()
    assert one.vacuum("X", T.M1, keep=1) == 1  # the first writer's first try is gone already, so is the last one's


def test_batches_count_once(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    bars = lambda v: minute_bars(spark, "2025-12-31 23:58", 4).withColumn("volume", F.lit(v))
    assert lake.upsert("X", T.M1, bars(1.0), "ticks", 0) == 4 and lake.upsert("X", T.M1, bars(2.0).limit(2), "ticks", 1) == 2
    assert lake.upsert("X", T.M1, bars(9.0), "ticks", 1) == 0 and lake.upsert("X", T.M1, bars(9.0), "ticks", 0) == 0
    assert lake.upsert("X", T.M1, bars(1.0).limit(0), "ticks", 2) == 0 and lake.version("X", T.M1)["batches"] == {"ticks": 2}
    assert sorted(r.volume for r in lake.load("X", T.M1, as_of=END).collect()) == [1.0, 1.0, 2.0, 2.0]
    assert lake.upsert("X", T.M1, bars(3.0), "other", 0) == 4


def test_writers_of_records_lose_and_double_nothing(spark, tmp_path):
    stores = [Meta(spark, str(tmp_path)) for _ in range(4)]

    def work(k):
        for i in range(15):
            stores[k].record_oos_unlock("oos", f"{k}-{i}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    rows = stores[0]._table("oos_unlocks").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 61)) and {r.reason for r in rows} == {f"{k}-{i}" for k in range(4) for i in range(15)}
    for k in range(4):  # a writer's own rows stay in order
        assert [r.reason for r in rows if r.reason.startswith(f"{k}-")] == [f"{k}-{i}" for i in range(15)]


def test_fetched_ranges_are_utc(spark, tmp_path):
    meta, tokyo = Meta(spark, str(tmp_path)), timezone(timedelta(hours=9))
    meta.record_fetch("X", "1m", datetime(2026, 1, 5, 9, tzinfo=tokyo), datetime(2026, 1, 5, 10, tzinfo=tokyo))
    assert meta.fetched_ranges("X", "1m") == [(datetime(2026, 1, 5), datetime(2026, 1, 5, 1))]
    with pytest.raises(ValueError, match="naive"):
        meta.record_fetch("X", "1m", datetime(2026, 1, 5), datetime(2026, 1, 6))


def test_put_if_absent(spark, tmp_path):
    f = Files(spark)
    assert f.put_if_absent(f"{tmp_path}/a/1", "é") and not f.put_if_absent(f"{tmp_path}/a/1", "x")
    assert f.read(f"file://{tmp_path}/a/1") == "é" and f.names(f"{tmp_path}/a") == ["1"] and f.names(f"{tmp_path}/none") == []
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda k: f.put_if_absent(f"{tmp_path}/a/2", str(k)), range(32))) == 1
    # a store that is not the local disk: renames decide
    far = f"viewfs://store/{tmp_path.name}"
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./" + tmp_path.name, f"file://{tmp_path}")
    assert f.put_if_absent(f"{far}/b/1", "one") and not f.put_if_absent(f"{far}/b/1", "two") and f.read(f"{far}/b/1") == "one"
