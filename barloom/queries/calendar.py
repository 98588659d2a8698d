"""Calendar functions at the ticks of ``orders``, which cross every change of the clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.queries.base import LDN, NY, TICKS_SQL, TYO, date_sql, easter_sql, holiday_sql, minutes_sql, open_sql, period_start_sql, session_sql, ticks, utc


def _at_ticks(**columns):
    def run(spark, sf_dir):
        return ticks(spark, sf_dir, "OR").select("id", "ts", *(f(F.col("ts")).alias(n) for n, f in columns.items()))

    return run


def _years(**columns):
    def run(spark, sf_dir):
        years = ticks(spark, sf_dir, "OR").select(F.year("ts").alias("year")).distinct()
        return years.select(F.col("year").cast("long").alias("year"), *(f(F.col("year")).alias(n) for n, f in columns.items()))

    return run


def _tick_sql(**columns):
    return f"SELECT id, ts, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM ({TICKS_SQL['OR']})"


_YEARS = f"(SELECT DISTINCT year(ts)::BIGINT AS year FROM ({TICKS_SQL['OR']}))"

QUERIES = {
    "local_minutes": _at_ticks(**{z: lambda t, zz=n: K.local_minutes(t, zz).cast("long") for z, n in (("ny", NY), ("ldn", LDN), ("tyo", TYO))}),
    "session_labels": _at_ticks(session=K.session_labels),
    "easter": _years(easter=lambda y: K.easter(y).cast("string")),
    "fx_holidays": _years(new_year=lambda y: K.fx_holidays(y)[0].cast("string"), good_friday=lambda y: K.fx_holidays(y)[1].cast("string"), christmas=lambda y: K.fx_holidays(y)[2].cast("string")),
    "is_fx_holiday": _at_ticks(holiday=K.is_fx_holiday),
    "is_market_open": _at_ticks(is_open=K.is_market_open),
    "trading_day_start": _at_ticks(ny=lambda t: K.trading_day_start(t, "ny"), jst=lambda t: K.trading_day_start(t, "jst")),
    "trading_day_label": _at_ticks(ny=lambda t: K.trading_day_label(t, "ny"), jst=lambda t: K.trading_day_label(t, "jst")),
    "local_trading_date": _at_ticks(ny=lambda t: K.local_trading_date(t, "ny").cast("string"), jst=lambda t: K.local_trading_date(t, "jst").cast("string"), week=lambda t: K.week_key(K.local_trading_date(t, "ny")).cast("string")),
    "trading_period_start": _at_ticks(ny=lambda t: K.trading_period_start(K.local_trading_date(t, "ny"), "ny"), jst=lambda t: K.trading_period_start(K.local_trading_date(t, "jst"), "jst")),
}

_ny, _jst = date_sql("ts", "ny"), date_sql("ts", "jst")
SQL = {
    "local_minutes": _tick_sql(**{z: f"{minutes_sql('ts', n)}::BIGINT" for z, n in (("ny", NY), ("ldn", LDN), ("tyo", TYO))}),
    "session_labels": _tick_sql(session=session_sql("ts")),
    "easter": f"SELECT year, {easter_sql('year')}::VARCHAR AS easter FROM {_YEARS}",
    "fx_holidays": f"SELECT year, make_date(year, 1, 1)::VARCHAR AS new_year, ({easter_sql('year')} - 2)::DATE::VARCHAR AS good_friday, make_date(year, 12, 25)::VARCHAR AS christmas FROM {_YEARS}",
    "is_fx_holiday": _tick_sql(holiday=holiday_sql("ts")),
    "is_market_open": _tick_sql(is_open=open_sql("ts")),
    "trading_day_start": _tick_sql(ny=period_start_sql(_ny, "ny"), jst=period_start_sql(_jst, "jst")),
    "trading_day_label": _tick_sql(ny=utc(f"({_ny}::TIMESTAMP)", NY), jst=utc(f"({_jst}::TIMESTAMP)", TYO)),
    "local_trading_date": _tick_sql(ny=f"{_ny}::VARCHAR", jst=f"{_jst}::VARCHAR", week=f"date_trunc('week', {_ny})::DATE::VARCHAR"),
    "trading_period_start": _tick_sql(ny=period_start_sql(_ny, "ny"), jst=period_start_sql(_jst, "jst")),
}
