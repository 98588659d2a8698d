"""Bars of the driver's tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.sources import ticks as T
from barloom.sources.shared import shared_path

VIEWS = {"EV": T.event_ticks, "OR": T.order_ticks}


def ticks(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return VIEWS[view](spark, sf_dir)


def bars(spark: SparkSession, sf_dir: str, view: str = "EV") -> DataFrame:
    return T.ticks_to_1m(ticks(spark, sf_dir, view))


scratch = shared_path

TICKS_SQL = {
    "EV": "SELECT 'EV' || (user_id % 4) AS symbol, ts, event_id AS id, 100.0::DOUBLE + value AS px, (json_extract_string(props, '$.k')::DOUBLE + 1.0::DOUBLE) / 1000.0::DOUBLE AS spr FROM events",
    "OR": "SELECT 'OR' || (o_custkey % 4) AS symbol, o_orderdate + to_minutes((o_orderkey % 1440)::BIGINT) AS ts, o_orderkey AS id, o_totalprice / 1000.0::DOUBLE AS px, (o_custkey % 7 + 1)::DOUBLE / 1000.0::DOUBLE AS spr FROM orders",
}
BARS_SQL = """
tk AS ({ticks}),
bk AS (SELECT symbol, time_bucket(INTERVAL '1 minute', ts) AS open_time, first(px ORDER BY ts, id) AS bid_open, max(px) AS bid_high, min(px) AS bid_low,
              last(px ORDER BY ts, id) AS bid_close, max(spr) AS spr, count(*)::DOUBLE AS volume FROM tk GROUP BY ALL),
b AS (SELECT symbol, open_time, open_time + INTERVAL '1 minute' AS close_time, bid_open, bid_high, bid_low, bid_close, bid_open + spr AS ask_open,
             bid_high + spr AS ask_high, bid_low + spr AS ask_low, bid_close + spr AS ask_close, volume FROM bk)"""


def with_bars(view: str = "EV", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BARS_SQL.format(ticks=TICKS_SQL[view])}"


def zone(t: str, name: str) -> str:
    return f"(({t} AT TIME ZONE 'UTC') AT TIME ZONE '{name}')"


def utc(wall: str, name: str) -> str:
    return f"(({wall} AT TIME ZONE '{name}') AT TIME ZONE 'UTC')"


NY, LDN, TYO = "America/New_York", "Europe/London", "Asia/Tokyo"


def minutes_sql(t: str, name: str) -> str:
    return f"(hour({zone(t, name)}) * 60 + minute({zone(t, name)}))"


def session_sql(t: str) -> str:
    ny = f"{minutes_sql(t, NY)} BETWEEN 480 AND 1019"
    ldn = f"{minutes_sql(t, LDN)} BETWEEN 480 AND 989"
    tyo = f"{minutes_sql(t, TYO)} BETWEEN 540 AND 1019"
    return f"CASE WHEN {ldn} AND {ny} THEN 'LDN_NY_OVERLAP' WHEN {ny} THEN 'NEWYORK' WHEN {ldn} THEN 'LONDON' WHEN {tyo} THEN 'TOKYO' ELSE 'OFF' END"


def easter_sql(y: str) -> str:
    """A different computus (Butcher's names, nested) than the Spark one, as a check on it."""
    a, b, c = f"({y} % 19)", f"({y} // 100)", f"({y} % 100)"
    h = f"((19 * {a} + {b} - {b} // 4 - (8 * {b} + 13) // 25 + 15) % 30)"
    el = f"((32 + 2 * ({b} % 4) + 2 * ({c} // 4) - {h} - {c} % 4) % 7)"
    m = f"(({a} + 11 * {h} + 19 * {el}) // 433)"
    mo = f"(({h} + {el} - 7 * {m} + 90) // 25)"
    return f"make_date({y}, {mo}, ({h} + {el} - 7 * {m} + 33 * {mo} + 19) % 32)"


def holiday_sql(t: str) -> str:
    d = f"{zone(t, NY)}"
    return f"(month({d}) * 100 + day({d}) IN (101, 1225) OR {d}::DATE = {easter_sql(f'year({d})')} - 2)"


def open_sql(t: str) -> str:
    n = zone(t, NY)
    return f"NOT (isodow({n}) = 6 OR (isodow({n}) = 7 AND hour({n}) < 17) OR (isodow({n}) = 5 AND hour({n}) >= 17) OR {holiday_sql(t)})"


def date_sql(t: str, name: str) -> str:
    return f"({zone(t, NY)} + INTERVAL 7 HOURS)::DATE" if name == "ny" else f"{zone(t, TYO)}::DATE"


def period_start_sql(d: str, name: str) -> str:
    return utc(f"({d}::TIMESTAMP - INTERVAL 7 HOURS)", NY) if name == "ny" else utc(f"({d}::TIMESTAMP)", TYO)
