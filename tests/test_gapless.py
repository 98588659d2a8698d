"""Reports on symbols without gaps: ``check`` has a row for each, the queries list those that their SQL lists."""

from datetime import datetime, timedelta

import duckdb
import pytest

from barloom import catalog
from barloom.operators import quality as Q
from barloom.schema import Timeframe
from tests.helpers import minute_bars, rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
MONDAY, SATURDAY = datetime(2024, 1, 8), datetime(2024, 1, 6)


def ticks(symbol, start, minutes, value=50.0):
    return [(start + timedelta(minutes=m, seconds=5), symbol, value + m % 3) for m in minutes]


FULL = ticks(0, MONDAY, range(60))
HOLED = ticks(1, MONDAY, [m for m in range(60) if not 20 <= m < 27])
SHUT = ticks(2, SATURDAY, range(0, 60, 2))  # nothing is due
MISSED = ticks(3, SATURDAY, [0, 7 * 1440])  # a week is due, and has no bar
CASES = {"some without gaps": FULL + HOLED, "all without gaps": FULL, "shut and missed": HOLED + SHUT + MISSED, "no symbol": HOLED + ticks(None, MONDAY, [0, 9])}


@pytest.fixture(params=CASES)
def events(request, spark, tmp_path):
    data = [(i, ts, user, "view", value, '{"k": %d}' % (i % 9)) for i, (ts, user, value) in enumerate(CASES[request.param])]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return rows(con.execute(SQL[name]).fetchdf())


def test_quality_report_equals_sql(spark, events):
    assert rows(QUERIES["quality_report"](spark, events).toPandas()) == by_sql(events, "quality_report")


def test_gap_summary_equals_sql(spark, events):
    assert rows(QUERIES["gap_summary"](spark, events).toPandas()) == by_sql(events, "gap_summary")


def test_operators_report_on_symbols_without_gaps(spark):
    r = Q.check(minute_bars(spark, "2026-01-05 00:00", 30), Timeframe.M1)
    assert [(x.actual_bars, x.gaps) for x in r.collect()] == [(30, [])]
    assert Q.gap_summary(r).first().summary == "coverage 100.00%, 0 gaps (0 of a day or more, longest other 0 min)"


def test_coverage_is_rounded_as_printf_does(spark):
    shares = [(36, 28800), (108, 28800), (201, 20000), (203, 20000), (1, 3), (7, 7), (0, 5)]
    reports = spark.createDataFrame([(f"{a}/{e}", a, e, []) for a, e in shares], "symbol string, actual_bars long, expected_bars long, gaps array<struct<from:string,to:string,missing_bars:bigint,minutes:double>>")
    got = {r.symbol: r.summary.split("%")[0] for r in Q.gap_summary(reports).collect()}
    printf = lambda a, e: duckdb.connect().execute(f"SELECT printf('coverage %.2f', 100.0::DOUBLE * {a} / {e}) AS s").fetchdf().s[0]
    assert got == {f"{a}/{e}": printf(a, e) for a, e in shares}
