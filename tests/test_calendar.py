from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from barloom.functions import caltime as K


def times(spark, *texts):
    return spark.createDataFrame([(datetime.fromisoformat(t),) for t in texts], "t timestamp_ntz")


@pytest.mark.parametrize("year, friday", [(2021, (4, 2)), (2024, (3, 29)), (2025, (4, 18)), (2026, (4, 3))])
def test_good_friday(spark, year, friday):
    assert spark.range(1).select(K.good_friday(F.lit(year))).first()[0] == date(year, *friday)


def test_days_of_a_year_are_23_to_25_hours(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2026-01-01 12:00:00', TIMESTAMP_NTZ'2026-12-31 12:00:00', INTERVAL 1 DAY)) AS t")
    day = K.local_trading_date(F.col("t"), "ny")
    span = K.trading_period_start(F.date_add(day, 1), "ny") - K.trading_period_start(day, "ny")
    got = {r[0].total_seconds() / 3600: r[1] for r in df.select(span.alias("h")).groupBy("h").count().collect()}
    assert got == {23: 1, 24: 363, 25: 1}


def test_start_and_date_are_inverse(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2026-03-01', TIMESTAMP_NTZ'2026-11-30', INTERVAL 97 MINUTES)) AS t")
    for name in ("ny", "jst"):
        assert df.where(K.trading_day_start(F.col("t"), name) != K.trading_period_start(K.local_trading_date(F.col("t"), name), name)).isEmpty()


def test_market_hours(spark):
    df = times(spark, "2026-01-10T12:00", "2026-01-11T21:59", "2026-01-11T22:00", "2026-01-09T21:59", "2026-01-09T22:00", "2026-01-01T15:00", "2026-04-03T15:00", "2026-12-25T15:00", "2026-01-06T03:00")
    assert [r[0] for r in df.select(K.is_market_open(F.col("t"))).collect()] == [False, False, True, True, False, False, False, False, True]


def test_sessions(spark):
    df = times(spark, "2026-01-05T00:00", "2026-01-05T08:00", "2026-01-05T14:00", "2026-01-05T17:00", "2026-01-05T22:00")
    assert [r[0] for r in df.select(K.session_labels(F.col("t"))).collect()] == ["TOKYO", "LONDON", "LDN_NY_OVERLAP", "NEWYORK", "OFF"]


def test_naive_times_are_refused():
    with pytest.raises(ValueError):
        K.ensure_utc_timestamp(datetime(2026, 1, 1))
    assert K.parse_cli_timestamp("2026-01-01T09:00+09:00") == datetime(2026, 1, 1)
    assert K.ensure_utc_timestamp(datetime(2026, 1, 1, tzinfo=timezone.utc)) == datetime(2026, 1, 1)
    with pytest.raises(ValueError):
        K.convention("utc")
