"""The data source of sides: what it reads, and which partitions filters leave."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from barloom.schema import Timeframe as T
from barloom.sources.bar_datasource import Sides, read_sides
from tests.helpers import minute_bars


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sides")
    for symbol in "XY":
        b = minute_bars(spark, "2025-11-29 00:00", 100_000, symbol=symbol, keep=lambda t: t.hour == 3 and t.minute < 20)
        for s in ("bid", "ask"):
            side = b.select("open_time", *(F.col(f"{s}_{f}").alias(f) for f in ("open", "high", "low", "close")), "volume", F.lit(1).alias("more"))
            (side if s == "bid" else side.where("minute(open_time) <> 7")).coalesce(1).write.parquet(str(root / symbol / "1m" / s))
    return str(root)


def test_all_bars_that_have_both_sides(spark, sides):
    got = read_sides(spark, sides)
    want = minute_bars(spark, "2025-11-29 00:00", 100_000, keep=lambda t: t.hour == 3 and t.minute < 20 and t.minute != 7)
    assert got.schema == want.schema
    assert sorted(map(tuple, got.where("symbol = 'X'").collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 2 * want.count() and got.rdd.getNumPartitions() == 8
    assert "bar_sides" in got._jdf.queryExecution().executedPlan().toString()


def utc(*t):
    return datetime(*t, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    "options, where, partitions",
    [
        ({"symbols": ("Y",)}, "symbol = 'Y'", 4),
        ({"symbols": ("Y", "Z")}, "symbol IN ('Y', 'Z')", 4),
        ({"symbols": ("X",), "start": utc(2026, 1, 2, 3, 5)}, "symbol = 'X' AND open_time >= TIMESTAMP_NTZ'2026-01-02 03:05:00'", 2),
        ({"start": utc(2025, 12, 5), "end": utc(2025, 12, 20, 3, 4)}, "open_time >= TIMESTAMP_NTZ'2025-12-05' AND open_time < TIMESTAMP_NTZ'2025-12-20 03:04:00'", 2),
        ({"end": utc(2025, 12, 1)}, "open_time < TIMESTAMP_NTZ'2025-12-01'", 2),
        ({"start": utc(2027, 1, 1)}, "false", 1),
    ],
)
def test_options_leave_few_partitions(spark, sides, options, where, partitions):
    got, every = read_sides(spark, sides, **options), read_sides(spark, sides)
    assert got.rdd.getNumPartitions() == partitions
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.where(where).collect()))
    assert every.where("symbol = 'X'").union(every).count() == 3 * 1330  # one table, with a filter and without


def test_as_a_bar_source(spark, sides):
    got = Sides(spark, sides).fetch("X", T.M1, utc(2025, 12, 1), utc(2025, 12, 3))
    assert got.count() == 38 and {r.symbol for r in got.collect()} == {"X"}
    assert Sides(spark, sides).fetch("none", T.M1, utc(2025, 12, 1), utc(2025, 12, 3)).count() == 0
    with pytest.raises(Exception, match="fixed length"):
        read_sides(spark, sides, T.D1_NY).count()
    assert read_sides(spark, sides, symbols=("Y",)).rdd.getNumPartitions() == 4
