"""Indicators, edge scans, periods, records and intervals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import edge as E
from barloom.operators import intervals as I
from barloom.operators.indicators import REGISTRY, compute
from barloom.operators.periods import Period, Settings, locked_count, visible_bars
from barloom.queries.base import NY, bars, date_sql, period_start_sql, session_sql, with_bars, zone
from barloom.sources import meta as M

SETTINGS = Settings("OR0", datetime(1995, 1, 1), "", "", {"training": Period("training", datetime(1995, 1, 1), datetime(1997, 12, 31)), "oos": Period("oos", datetime(1998, 1, 1), datetime(2001, 12, 31), True)})


def _indicator(name, digits):
    def run(spark, sf_dir):
        out = compute(bars(spark, sf_dir), name)
        return out.select("symbol", "open_time", *(F.round(c, digits).alias(c) for c in REGISTRY[name].outputs))

    return run


def _frame(p: int) -> str:
    return f"WINDOW f AS (PARTITION BY symbol ORDER BY open_time ROWS {p - 1} PRECEDING)"


_MID = "(bid_close + ask_close) / 2"
_FULL = "CASE WHEN count({x}) OVER f = {p} THEN {e} OVER f END"
_N = f"n AS MATERIALIZED (SELECT symbol, open_time, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS k, {_MID} AS x, (bid_high + ask_high) / 2 AS hi, (bid_low + ask_low) / 2 AS lo, lag({_MID}) OVER (PARTITION BY symbol ORDER BY open_time) AS p FROM b)"
_STEP = "FROM y JOIN n ON n.symbol = y.symbol AND n.k = y.k + 1"
_RSI = f"""{_N}, y AS (SELECT symbol, k, greatest(x - p, 0::DOUBLE) AS g, greatest(p - x, 0::DOUBLE) AS l FROM n WHERE k = 2
  UNION ALL SELECT n.symbol, n.k, g + (greatest(n.x - n.p, 0::DOUBLE) - g) / 14, l + (greatest(n.p - n.x, 0::DOUBLE) - l) / 14 {_STEP}),
rs AS (SELECT n.symbol, n.open_time, CASE WHEN n.k > 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM n LEFT JOIN y USING (symbol, k))"""

_INDICATOR_SQL = {
    "sma": f"{with_bars()} SELECT symbol, open_time, round({_FULL.format(x='volume', p=20, e=f'avg({_MID})')}, 8) AS sma FROM b {_frame(20)}",
    "bbands": f"""{with_bars()} SELECT symbol, open_time, round(m - 2 * s, 7) AS lower, round(m, 7) AS middle, round(m + 2 * s, 7) AS upper FROM (
        SELECT symbol, open_time, {_FULL.format(x='volume', p=20, e=f'avg({_MID})')} AS m, {_FULL.format(x='volume', p=20, e=f'stddev_pop({_MID})')} AS s FROM b {_frame(20)})""",
    "donchian": f"""{with_bars()} SELECT symbol, open_time, round(l, 8) AS lower, round(u, 8) AS upper, round(u - l, 8) AS width FROM (
        SELECT symbol, open_time, {_FULL.format(x='volume', p=20, e='min((bid_low + ask_low) / 2)')} AS l, {_FULL.format(x='volume', p=20, e='max((bid_high + ask_high) / 2)')} AS u FROM b {_frame(20)})""",
    "hist_vol": f"""{with_bars()} SELECT symbol, open_time, round({_FULL.format(x='r', p=60, e='stddev_pop(r)')}, 8) AS hist_vol FROM (
        SELECT symbol, open_time, ln({_MID}) - ln(lag({_MID}) OVER (PARTITION BY symbol ORDER BY open_time)) AS r FROM b) {_frame(60)}""",
    "vwap": f"""{with_bars()} SELECT symbol, open_time, round(sum(t * volume) OVER d / nullif(sum(volume) OVER d, 0) + 3.3e-8::DOUBLE, 6) AS vwap FROM (
        SELECT *, ((bid_high + ask_high) / 2 + (bid_low + ask_low) / 2 + {_MID}) / 3 AS t, {date_sql('open_time', 'ny')} AS day FROM b)
        WINDOW d AS (PARTITION BY symbol, day ORDER BY open_time ROWS UNBOUNDED PRECEDING)""",
    "ema": f"""{with_bars(recursive=True)}, {_N}, y AS (SELECT symbol, open_time, k, x AS v FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.open_time, n.k, v + 2::DOUBLE / 21 * (n.x - v) {_STEP})
        SELECT symbol, open_time, round(v, 7) AS ema FROM y""",
    "rsi": f"{with_bars(recursive=True)}, {_RSI} SELECT symbol, open_time, round(rsi, 6) AS rsi FROM rs",
    "macd": f"""{with_bars(recursive=True)}, {_N}, y AS (SELECT symbol, open_time, k, x AS f, x AS s, 0::DOUBLE AS g FROM n WHERE k = 1
        UNION ALL SELECT symbol, open_time, k, f, s, g + 0.2::DOUBLE * (f - s - g) FROM (SELECT n.symbol, n.open_time, n.k, f + 2::DOUBLE / 13 * (n.x - f) AS f, s + 2::DOUBLE / 27 * (n.x - s) AS s, g {_STEP}))
        SELECT symbol, open_time, round(f - s, 7) AS macd, round(g, 7) AS signal, round(f - s - g, 7) AS histogram FROM y""",
    "atr": f"""{with_bars(recursive=True)}, {_N}, y AS (SELECT symbol, open_time, k, hi - lo AS v FROM n WHERE k = 1
        UNION ALL SELECT n.symbol, n.open_time, n.k, v + (greatest(n.hi - n.lo, abs(n.hi - n.p), abs(n.lo - n.p)) - v) / 14 {_STEP})
        SELECT symbol, open_time, round(CASE WHEN k >= 14 THEN v END, 7) AS atr FROM y""",
}
_DIGITS = {"sma": 8, "donchian": 8, "hist_vol": 8, "rsi": 6}


def _signalled(spark, sf_dir):
    return bars(spark, sf_dir).withColumn("signal", F.col("bid_close") > 150)


def _shown(df):
    more = ["n_signals"] if "n_signals" in df.columns else []
    return df.select("symbol", "grp", F.col("horizon").cast("long").alias("horizon"), *more, F.col("n").cast("long").alias("n"), *(F.round(c, 5).alias(c) for c in E.STATS[1:]))


def scan_sql(signal: str = "bid_close > 150", view: str = "EV", horizons=E.HORIZONS, groups: bool = False, where: str = "TRUE", head: str | None = None, source: str = "b", side: str = "long", within: str = "TRUE") -> str:
    move = "(z.bid_close - a.ask_close) / 0.01::DOUBLE" if side == "long" else "(a.bid_close - z.ask_close) / 0.01::DOUBLE"
    g = f"unnest(['ALL', {session_sql('open_time')}])" if groups else "'ALL'"
    t = f"CASE {' '.join(f'WHEN floor(n_eff - 1) = {i} THEN {v}::DOUBLE' for i, v in enumerate(E.T95, 1))} WHEN n_eff - 1 >= 31 THEN 1.959964::DOUBLE * (1 + 1 / (4 * (n_eff - 1))) END"
    return f"""{head or with_bars(view)}, pb AS MATERIALIZED (SELECT *, coalesce({signal}, FALSE) AS sig, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS pos FROM {source} WHERE {where}),
    hz AS (SELECT unnest({list(horizons)})::BIGINT AS horizon),
    sm AS MATERIALIZED (SELECT symbol, grp, horizon, pos, ret FROM (SELECT a.symbol, a.open_time, horizon, a.pos, {move} AS ret FROM pb a, hz, pb z WHERE a.sig AND z.symbol = a.symbol AND z.pos = a.pos + horizon AND {within}), LATERAL (SELECT {g} AS grp)),
    ov AS (SELECT a.symbol, a.grp, a.horizon, sum(1 - abs(a.pos - z.pos)::DOUBLE / a.horizon) AS o FROM sm a JOIN sm z ON a.symbol = z.symbol AND a.grp = z.grp AND a.horizon = z.horizon AND z.pos BETWEEN a.pos - a.horizon AND a.pos + a.horizon GROUP BY ALL),
    st AS (SELECT symbol, grp, horizon, count(*) AS n, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, avg((ret > 0)::INT) AS win_rate, stddev_samp(ret) AS std FROM sm GROUP BY ALL),
    s2 AS (SELECT *, n * n / o AS n_eff FROM st JOIN ov USING (symbol, grp, horizon)),
    s3 AS (SELECT *, CASE WHEN n_eff >= 2 AND n >= 2 THEN ({t}) * std / sqrt(n_eff) END AS half FROM s2),
    sp AS (SELECT symbol, grp, horizon, n_signals FROM (SELECT symbol, grp, count(*) FILTER (WHERE sig)::BIGINT AS n_signals FROM (SELECT symbol, sig, {g} AS grp FROM pb) GROUP BY ALL), hz)
    SELECT symbol, grp, horizon, n_signals, coalesce(n, 0)::BIGINT AS n, coalesce(round(n_eff, 5), 0) AS n_eff, round(mean, 5) AS mean, round(median, 5) AS median, round(win_rate, 5) AS win_rate, round(std, 5) AS std,
    round(mean - half, 5) AS ci_lo, round(mean + half, 5) AS ci_hi FROM sp LEFT JOIN s3 USING (symbol, grp, horizon)"""


def forward_returns(spark, sf_dir):
    columns = {"long_net": {"h": 5}, "short_net": {"h": 5, "direction": "short"}, "long_gross": {"h": 60, "deduct_spread": False}}
    out = E.forward_returns(_signalled(spark, sf_dir), columns)
    return out.select("symbol", "open_time", *(F.round(c, 6).alias(c) for c in columns))


def signal_align(spark, sf_dir):
    b = bars(spark, sf_dir)
    s = b.where(F.minute("open_time") % 3 == 0).select("symbol", "open_time", (F.col("volume") >= 1).alias("signal"))
    return E.align(b, s).select("symbol", "open_time", "signal")


def _period_scan(spark, sf_dir):
    b = bars(spark, sf_dir, "OR").withColumn("signal", F.col("bid_close") > 150)
    return _shown(E.scan_period(b, SETTINGS, "training", horizons=(1, 5, 15)))


def _bad(b):
    """Parts of some hours, some of which overlap, and a weekend."""
    hour = F.window("open_time", "1 hour").start
    hours = b.select("symbol", hour.alias("h")).distinct().where("hour(h) % 6 = 2 AND day(h) % 3 = 0")
    cut = lambda a, z: hours.select("symbol", (F.col("h") + F.expr(f"interval {a} minutes")).alias("start"), (F.col("h") + F.expr(f"interval {z} minutes")).alias("stop"))
    return cut(10, 40).union(cut(30, 70)).union(b.select("symbol").distinct().selectExpr("symbol", "TIMESTAMP_NTZ'2024-01-13 00:00:30'", "TIMESTAMP_NTZ'2024-01-14 12:00:00'"))


def edge_scan_excluding(spark, sf_dir):
    return _shown(E.scan_excluding(_signalled(spark, sf_dir), _bad(bars(spark, sf_dir)), horizons=(1, 15, 60)))


_EXCLUDING_HEAD = f"""{with_bars()}, h AS (SELECT DISTINCT symbol, time_bucket(INTERVAL '1 hour', open_time) AS h FROM b WHERE hour(open_time) % 6 = 2 AND day(open_time) % 3 = 0),
    bad AS (SELECT symbol, h + INTERVAL '10 minutes' AS s, h + INTERVAL '40 minutes' AS e FROM h UNION ALL SELECT symbol, h + INTERVAL '30 minutes', h + INTERVAL '70 minutes' FROM h
            UNION ALL SELECT DISTINCT symbol, TIMESTAMP '2024-01-13 00:00:30', TIMESTAMP '2024-01-14 12:00:00' FROM b),
    cl AS (SELECT b.*, (SELECT count(*) FROM bad WHERE bad.symbol = b.symbol AND s < close_time) AS segment FROM b WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.symbol = b.symbol AND s < close_time AND e > open_time))"""


def flagship(spark, sf_dir, horizons=(1, 5, 15)):
    """RSI(14) below 30 on minute bars: forward returns net of spread, by session and horizon."""
    return _shown(E.scan_condition(bars(spark, sf_dir), "rsi", "<", 30, horizons=horizons, group_by="session"))


def edge_json(spark, sf_dir):
    """A scan by session as one JSON document a symbol; numbers have five decimals, so that both engines write them alike."""
    b = _signalled(spark, sf_dir)
    stats = E.scan(b, horizons=(5, 60), group_by="session")
    stats = stats.select("symbol", "grp", F.col("horizon").cast("long").alias("horizon"), F.col("n").cast("long").alias("n"), *(F.round(c, 5).cast("decimal(20,5)").alias(c) for c in E.STATS[1:]))
    return E.edge_json(stats, E.covered(b))


_ROW = "'{\"horizon\":' || horizon || ',\"n\":' || n || " + " || ".join(f"',\"{c}\":' || coalesce({c}::DECIMAL(20,5)::VARCHAR, 'null')" for c in E.STATS[1:]) + " || '}'"
_TIME = "'%Y-%m-%dT%H:%M:%S+00:00'"


def _ranges(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select((F.col("user_id") % 50).alias("key"), F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 397 + 1).cast("int"))).alias("stop"))


_RANGES = "r AS (SELECT user_id % 50 AS key, ts AS start, ts + to_minutes((event_id % 397 + 1)::BIGINT) AS stop FROM events)"
_MERGED = f"""{_RANGES}, i AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)::INT AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM i), m AS (SELECT key, min(start) AS start, max(stop) AS stop FROM g GROUP BY key, island)"""


def missing_ranges(spark, sf_dir):
    r = _ranges(spark, sf_dir)
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    bounds = r.select("key").distinct().select("key", t("2024-01-05 00:00:00").alias("lo"), t("2024-01-12 06:00:00").alias("hi"))
    return I.missing_ranges(r, bounds)


def chunks(spark, sf_dir):
    return I.chunks(_ranges(spark, sf_dir).groupBy("key").agg(F.min("start").alias("start"), F.max("stop").alias("stop")), 3)


def _reports(spark, sf_dir):
    """A row for each symbol and New York day with bars, in order: every fourth without payload, quarantined, whole or raw."""
    b = bars(spark, sf_dir).groupBy("symbol", F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(NY), F.col("open_time"))).alias("day")).agg(F.count("*").alias("n"))
    b = b.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("day")).cast("long"))
    whole = F.concat(F.lit("{"), F.lit(",".join(f'"{f}":0' for f in M.REPORT_FIELDS)), F.lit(',"day":"'), F.col("day").cast("string"), F.lit('"}'))
    bad = F.concat(F.lit('{"status":"quarantined","bar_count":'), F.col("n").cast("string"), F.lit("}"))
    raw = F.concat(F.lit('{"bars":'), F.col("n").cast("string"), F.lit("}"))
    k = F.col("seq") % 4
    return b.select("seq", "symbol", F.when(k == 1, bad).when(k == 2, whole).when(k == 3, raw).alias("payload"))


_REPORTS = f"""{with_bars()}, d AS (SELECT symbol, {zone('open_time', NY)}::DATE AS day, count(*) AS n FROM b GROUP BY ALL),
q AS (SELECT symbol, day, n, row_number() OVER (PARTITION BY symbol ORDER BY day)::BIGINT AS seq FROM d),
rp AS (SELECT seq, symbol, CASE seq % 4 WHEN 1 THEN '{{"status":"quarantined","bar_count":' || n || '}}' WHEN 2 THEN '{{{",".join(f'"{f}":0' for f in M.REPORT_FIELDS)},"day":"' || day || '"}}'
       WHEN 3 THEN '{{"bars":' || n || '}}' END AS payload FROM q)"""

def vwap(spark, sf_dir):
    """Prices have few decimals, so their means lie on ties of any rounding; a shift of 3.3e-8 moves them off."""
    return compute(bars(spark, sf_dir), "vwap").select("symbol", "open_time", F.round(F.col("vwap") + 3.3e-8, 6).alias("vwap"))


QUERIES = {
    **{n: _indicator(n, _DIGITS.get(n, 7)) for n in _INDICATOR_SQL},
    "vwap": vwap,
    "signal_threshold": lambda s, d: compute(bars(s, d), "donchian").select("symbol", "open_time", E.threshold("width", ">", 50).alias("wide"), E.threshold("lower", "<", 101).alias("low")),
    "signal_align": signal_align,
    "forward_returns": forward_returns,
    "effective_n": lambda s, d: E.effective_n(E.samples(_signalled(s, d))).select("symbol", "grp", F.col("horizon").cast("long").alias("horizon"), "n", F.round("n_eff", 5).alias("n_eff")),
    "t95": lambda s, d: s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 120 / 2).alias("df")).distinct().select("df", F.round(E.t95(F.col("df")), 9).alias("t")),
    "horizon_stats": lambda s, d: _shown(E.horizon_stats(E.samples(_signalled(s, d), direction="short"))),
    "edge_scan": lambda s, d: _shown(E.scan(_signalled(s, d))),
    "edge_scan_by_session": lambda s, d: _shown(E.scan(_signalled(s, d), group_by="session")),
    "edge_scan_period": _period_scan,
    "edge_scan_excluding": edge_scan_excluding,
    "edge_json": edge_json,
    "edge_covered": lambda s, d: E.covered(_signalled(s, d), "short", False),
    "flagship_rsi_scan": flagship,
    "period_slice": lambda s, d: SETTINGS.slice_bars(bars(s, d, "OR"), "training").select("symbol", "open_time", "bid_close"),
    "locked_count": lambda s, d: locked_count(bars(s, d, "OR"), SETTINGS),
    "visible_bars": lambda s, d: visible_bars(bars(s, d, "OR"), SETTINGS).select("symbol", "open_time", "bid_close"),
    "merge_ranges": lambda s, d: I.merge_ranges(_ranges(s, d)),
    "missing_ranges": missing_ranges,
    "chunks": chunks,
    "latest_quality": lambda s, d: M.latest(_reports(s, d), "symbol"),
    "quality_history": lambda s, d: M.history(_reports(s, d), "symbol").withColumn("place", F.col("place").cast("long")),
    "quality_view": lambda s, d: _reports(s, d).select("symbol", "seq", M.report_kind(F.col("payload")).alias("kind")),
    "quarantine_filter": lambda s, d: M.quarantined(_reports(s, d)),
}

_RSI_HEAD = f"{with_bars(recursive=True)}, {_RSI}, br AS (SELECT b.*, rs.rsi FROM b JOIN rs USING (symbol, open_time))"
SQL = {
    **_INDICATOR_SQL,
    "signal_threshold": f"""{with_bars()}, w AS (SELECT symbol, open_time, {_FULL.format(x='volume', p=20, e='min((bid_low + ask_low) / 2)')} AS l, {_FULL.format(x='volume', p=20, e='max((bid_high + ask_high) / 2)')} AS u FROM b {_frame(20)})
        SELECT symbol, open_time, coalesce(u - l > 50, FALSE) AS wide, coalesce(l < 101, FALSE) AS low FROM w""",
    "signal_align": f"{with_bars()} SELECT symbol, open_time, minute(open_time) % 3 = 0 AS signal FROM b",
    "forward_returns": f"""{with_bars()} SELECT symbol, open_time, round((lead(bid_close, 5) OVER w - ask_close) / 0.01::DOUBLE, 6) AS long_net, round((bid_close - lead(ask_close, 5) OVER w) / 0.01::DOUBLE, 6) AS short_net,
        round((lead({_MID}, 60) OVER w - {_MID}) / 0.01::DOUBLE, 6) AS long_gross FROM b WINDOW w AS (PARTITION BY symbol ORDER BY open_time)""",
    "effective_n": f"SELECT symbol, grp, horizon, n, n_eff FROM ({scan_sql()}) WHERE n > 0",
    "t95": f"""SELECT df, round(CASE {' '.join(f'WHEN floor(df) = {i} THEN {v}::DOUBLE' for i, v in enumerate(E.T95, 1))} WHEN df >= 31 THEN 1.959964::DOUBLE * (1 + 1 / (4 * df)) END, 9) AS t
        FROM (SELECT DISTINCT (event_id % 120)::DOUBLE / 2 AS df FROM events)""",
    "horizon_stats": f"SELECT * EXCLUDE (n_signals) FROM ({scan_sql(side='short')}) WHERE n > 0",
    "edge_scan": scan_sql(),
    "edge_scan_by_session": scan_sql(groups=True),
    "edge_scan_excluding": scan_sql(horizons=(1, 15, 60), head=_EXCLUDING_HEAD, source="cl", within="z.segment = a.segment"),
    "edge_scan_period": scan_sql(view="OR", horizons=(1, 5, 15), where="open_time >= TIMESTAMP '1995-01-01' AND open_time < TIMESTAMP '1998-01-01'"),
    "edge_json": f"""SELECT symbol, '{{"n_signals":' || n_signals || ',"direction":"long","deduct_spread":true,"covered_start":"' || covered_start || '","covered_end":"' || covered_end
            || '","horizons":' || max(rows) FILTER (WHERE grp = 'ALL') || ',"by_group":{{' || string_agg('"' || grp || '":' || rows, ',' ORDER BY grp) FILTER (WHERE grp <> 'ALL') || '}}}}' AS json
        FROM (SELECT symbol, grp, '[' || string_agg({_ROW}, ',' ORDER BY horizon) || ']' AS rows FROM ({scan_sql(horizons=(5, 60), groups=True)}) GROUP BY ALL)
        JOIN ({with_bars()} SELECT symbol, count(*) FILTER (WHERE bid_close > 150) AS n_signals, strftime(min(open_time), {_TIME}) AS covered_start, strftime(max(open_time), {_TIME}) AS covered_end FROM b GROUP BY symbol) USING (symbol)
        GROUP BY symbol, n_signals, covered_start, covered_end""",
    "edge_covered": f"{with_bars()} SELECT symbol, count(*) FILTER (WHERE bid_close > 150)::BIGINT AS n_signals, 'short' AS direction, false AS deduct_spread, min(open_time) AS covered_start, max(open_time) AS covered_end FROM b GROUP BY symbol",
    "flagship_rsi_scan": scan_sql("rsi < 30", horizons=(1, 5, 15), groups=True, head=_RSI_HEAD, source="br"),
    "period_slice": f"{with_bars('OR')} SELECT symbol, open_time, bid_close FROM b WHERE open_time < TIMESTAMP '1998-01-01'",
    "locked_count": f"{with_bars('OR')} SELECT symbol, count(*) FILTER (WHERE open_time >= TIMESTAMP '1998-01-01' AND open_time < TIMESTAMP '2002-01-01')::BIGINT AS locked_bars FROM b GROUP BY symbol",
    "visible_bars": f"{with_bars('OR')} SELECT symbol, open_time, bid_close FROM b WHERE NOT (open_time >= TIMESTAMP '1998-01-01' AND open_time < TIMESTAMP '2002-01-01')",
    "merge_ranges": f"WITH {_MERGED} SELECT key, start, stop FROM m",
    "missing_ranges": f"""WITH {_MERGED}, c AS (SELECT key, greatest(start, TIMESTAMP '2024-01-05') AS start, least(stop, TIMESTAMP '2024-01-12 06:00:00') AS stop FROM m WHERE stop > TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-12 06:00:00'),
        e AS (SELECT key, start, stop FROM c UNION ALL SELECT DISTINCT key, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-05' FROM r UNION ALL SELECT DISTINCT key, TIMESTAMP '2024-01-12 06:00:00', TIMESTAMP '2024-01-12 06:00:00' FROM r),
        o AS (SELECT key, max(stop) OVER (PARTITION BY key ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS start, lead(start) OVER (PARTITION BY key ORDER BY start, stop) AS stop FROM e)
        SELECT key, start, stop FROM o WHERE start < stop""",
    "chunks": f"""WITH {_RANGES}, s AS (SELECT key, min(start) AS a, max(stop) AS z FROM r GROUP BY key), u AS (SELECT key, z, unnest(generate_series(a, z, INTERVAL 3 DAYS)) AS start FROM s)
        SELECT key, start, least(start + INTERVAL 3 DAYS, z) AS stop FROM u WHERE start < z""",
    "latest_quality": f"{_REPORTS} SELECT symbol, last(payload ORDER BY seq) AS payload FROM rp GROUP BY symbol",
    "quality_history": f"{_REPORTS} SELECT symbol, seq AS place, payload FROM rp",
    "quality_view": f"{_REPORTS} SELECT symbol, seq, CASE seq % 4 WHEN 1 THEN 'quarantined' WHEN 2 THEN 'summary' WHEN 3 THEN 'raw' ELSE 'none' END AS kind FROM rp",
    "quarantine_filter": f"{_REPORTS} SELECT seq, symbol, payload FROM rp WHERE json_extract_string(payload, '$.status') = 'quarantined'",
}
