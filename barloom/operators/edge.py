"""Edge scan: distributions of returns after a signal, with intervals corrected for overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions import caltime as K
from barloom.operators import indicators
from barloom.operators.interval_join import segments
from barloom.operators.spans import block_of, positioned, quantile, windowed
from barloom.operators.periods import Settings, authorize_locked_access
from barloom.sources.shared import materialized

HORIZONS = (1, 5, 15, 30, 60)
# Two-sided 95 % quantiles of Student's t for 1 to 30 degrees of freedom, and of the normal distribution.
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
NORMAL95 = 1.959964
#: Positions of a block of samples.
BLOCK = 50_000


def threshold(column: str, op: str, value: float) -> Column:
    """Whether a column is below or above a value; null is neither."""
    if op not in ("<", ">"):
        raise ValueError(f"unknown operator {op!r}: use < or >")
    c = F.col(column)
    return F.coalesce(c < value if op == "<" else c > value, F.lit(False))


def align(bars: DataFrame, signal: DataFrame) -> DataFrame:
    """``bars`` with ``signal`` (symbol, open_time, signal) by time; bars it lacks have none."""
    s = signal.select("symbol", "open_time", F.col("signal").alias("_s"))
    return bars.join(s, ["symbol", "open_time"], "left").withColumn("signal", F.coalesce("_s", F.lit(False))).drop("_s")


def forward_return(w: WindowSpec, h: int, direction: str = "long", pip: float = 0.01, deduct_spread: bool = True) -> Column:
    """Pips won by a trade at this bar's close that ends ``h`` rows later in the window ``w``; null where there is none."""
    mid = (F.col("bid_close") + F.col("ask_close")) / 2
    bid, ask = (F.col("bid_close"), F.col("ask_close")) if deduct_spread else (mid, mid)
    move = F.lead(bid, h).over(w) - ask if direction == "long" else bid - F.lead(ask, h).over(w)
    return move / pip


def forward_returns(bars: DataFrame, columns: dict[str, dict], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``bars`` with a column for each name: its forward return by these options (``h``, ``direction``, ``pip``, ``deduct_spread``), within a series by ``keys``."""
    run = lambda df, w: df.withColumns({name: forward_return(w, **options) for name, options in columns.items()})
    return windowed(bars, list(keys), run, ahead=max(o["h"] for o in columns.values()))


def _check(horizons, direction, pip, group_by) -> None:
    if direction not in ("long", "short"):
        raise ValueError(f"direction must be long or short, not {direction!r}")
    if pip <= 0:
        raise ValueError("pip must be positive")
    if group_by not in (None, "session"):
        raise ValueError(f"group_by must be None or session, not {group_by!r}")
    if not horizons or min(horizons) <= 0:
        raise ValueError("horizons must be positive")


def seen(bars: DataFrame, horizons=HORIZONS, direction="long", pip=0.01, deduct_spread=True, group_by=None) -> DataFrame:
    """symbol, signal, grps, pos and the forward return for each horizon (``_r5``, …) of all bars; positions count all bars of the symbol.

    If ``bars`` have ``segment``, a return stays within its segment.
    """
    keys = ("symbol", "segment") if "segment" in bars.columns else ("symbol",)
    columns = {f"_r{h}": {"h": h, "direction": direction, "pip": pip, "deduct_spread": deduct_spread} for h in horizons}
    df = forward_returns(positioned(bars, ["symbol"]), columns, keys)
    groups = F.array(F.lit("ALL"), K.session_labels(F.col("open_time"))) if group_by else F.array(F.lit("ALL"))
    return df.select("symbol", "signal", groups.alias("grps"), (F.col("_pos") + 1).alias("pos"), *columns)


def samples(bars: DataFrame, horizons=HORIZONS, direction="long", pip=0.01, deduct_spread=True, group_by=None) -> DataFrame:
    """symbol, grp, horizon, pos, ret of each usable signal; ``bars`` has ``signal``."""
    return _samples(seen(bars, horizons, direction, pip, deduct_spread, group_by), horizons)


def _samples(df: DataFrame, horizons) -> DataFrame:
    df = df.where("signal").withColumn("x", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_r{h}").alias("ret")) for h in horizons))))
    df = df.where("x.ret IS NOT NULL").select("symbol", "pos", "x.horizon", "x.ret", "grps")
    return df.select("symbol", F.explode("grps").alias("grp"), "horizon", "pos", "ret")


def with_overlap(df: DataFrame) -> DataFrame:
    """``samples`` with ``overlap``: the sum over samples of 1 - distance / horizon, where positive.

    Ordered by position over horizon, those within one unit either way overlap: two range frames hold counts and sums.
    Samples are cut into blocks by position, each with those of its neighbours that overlap its own.
    """
    w = Window.partitionBy("symbol", "grp", "horizon", "_block").orderBy("_u")
    size = F.greatest(F.lit(BLOCK), "horizon")
    place = lambda shift: block_of(F.col("pos") + shift, size)
    df = df.withColumn("_block", F.explode(F.array_distinct(F.array(place(0), place(F.col("horizon")), place(-F.col("horizon"))))))
    df = df.withColumn("_u", F.col("pos") / F.col("horizon").cast("double"))
    back, ahead = w.rangeBetween(-1, 0), w.rangeBetween(0, 1)
    near = lambda f, frame: (f("pos").over(frame)).cast("double")
    apart = F.col("pos") * near(F.count, back) - near(F.sum, back) + near(F.sum, ahead) - F.col("pos") * near(F.count, ahead)
    df = df.withColumn("overlap", near(F.count, back) + near(F.count, ahead) - 1 - apart / F.col("horizon"))
    return df.where(F.col("_block") == place(0)).drop("_u", "_block")


def effective_n(df: DataFrame) -> DataFrame:
    """symbol, grp, horizon, n, n_eff of ``samples``: n squared over the sum of overlaps."""
    g = with_overlap(df).groupBy("symbol", "grp", "horizon").agg(F.count("*").alias("n"), F.sum("overlap").alias("o"))
    return g.select("symbol", "grp", "horizon", "n", (F.col("n") * F.col("n") / F.col("o")).alias("n_eff"))


def t95(df: Column) -> Column:
    """Student's t for 95 %, two-sided: the table at the floor of ``df``, beyond 30 an expansion; null at 0 and below."""
    n = F.floor(df).cast("int")
    table = F.get(F.array(*(F.lit(float(t)) for t in T95)), n - 1)
    return F.when(n < 1, None).when(n <= len(T95), table).otherwise(NORMAL95 * (1 + 1 / (4 * df)))


def horizon_stats(df: DataFrame) -> DataFrame:
    """Statistics of ``samples`` by symbol, group and horizon. The interval is null below two (effective) samples."""
    keys = ["symbol", "grp", "horizon"]
    g = with_overlap(df).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("overlap").alias("o"), F.avg("ret").alias("mean"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.stddev_samp("ret").alias("std"),
    )
    g = g.join(quantile(df, keys, "ret", 0.5, "median"), keys, "left")
    g = g.withColumn("n_eff", F.col("n") * F.col("n") / F.col("o")).drop("o")
    half = F.when((F.col("n_eff") >= 2) & (F.col("n") >= 2), t95(F.col("n_eff") - 1) * F.col("std") / F.sqrt("n_eff"))
    return g.withColumns({"ci_lo": F.col("mean") - half, "ci_hi": F.col("mean") + half})


STATS = ("n", "n_eff", "mean", "median", "win_rate", "std", "ci_lo", "ci_hi")


def scan(bars: DataFrame, horizons=HORIZONS, direction="long", pip=0.01, deduct_spread=True, group_by=None) -> DataFrame:
    """symbol, grp, horizon, n_signals and the statistics of ``bars`` with ``signal``.

    ``grp`` is ALL and, with ``group_by="session"``, each session that the bars have; groups and horizons without a
    signal appear with n 0. ``n_signals`` counts signals, also those too late for a return. Returns look ``h`` rows ahead, whatever
    session those are in. ``covered`` tells what a scan saw. Bars are positioned, and their indicator computed, once: into a table in the shared folder that all
    statistics read.
    """
    _check(horizons, direction, pip, group_by)
    table = materialized(seen(bars, horizons, direction, pip, deduct_spread, group_by))
    stats = horizon_stats(_samples(table, horizons))
    spine = table.select("symbol", "signal", F.explode("grps").alias("grp")).groupBy("symbol", "grp").agg(F.count_if("signal").alias("n_signals"))
    spine = spine.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    out = spine.join(stats, ["symbol", "grp", "horizon"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "n_eff": F.coalesce("n_eff", F.lit(0.0))}).select("symbol", "grp", "horizon", "n_signals", *STATS)


def scan_excluding(bars: DataFrame, bad: DataFrame, **options) -> DataFrame:
    """``scan`` of the bars that no interval of ``bad`` (symbol, start, stop) touches; no return crosses a removed stretch.

    ``signal`` may come from all bars. Returns end ``h`` bars later in the same segment, so samples of two segments never overlap.
    """
    return scan(segments(bars, bad), **options)


def covered(bars: DataFrame, direction="long", deduct_spread=True) -> DataFrame:
    """symbol, n_signals, direction, deduct_spread, covered_start, covered_end: what a scan of ``bars`` with ``signal`` sees and how."""
    g = bars.groupBy("symbol").agg(F.count_if("signal").alias("n_signals"), F.min("open_time").alias("covered_start"), F.max("open_time").alias("covered_end"))
    return g.select("symbol", "n_signals", F.lit(direction).alias("direction"), F.lit(deduct_spread).alias("deduct_spread"), "covered_start", "covered_end")


def scan_period(bars: DataFrame, settings: Settings, period: str, allow_locked: bool = False, reason: str | None = None, meta=None, **options) -> DataFrame:
    """``scan`` of one period only: cut first, so no return crosses its end. ``signal`` may come from all of history."""
    if settings.period(period).locked:
        if not allow_locked:
            settings.slice_bars(bars, period)
        authorize_locked_access(settings, period, reason, meta)
    return scan(settings.slice_bars(bars, period, allow_locked=True), **options)


def scan_condition(bars: DataFrame, name: str, op: str, value: float, column: str | None = None, params: dict | None = None, settings: Settings | None = None, period: str | None = None, **options) -> DataFrame:
    """Indicator over all bars, predicate, then the scan (of a period)."""
    if name not in indicators.REGISTRY:
        raise ValueError(f"unknown indicator {name!r}")
    outputs = indicators.REGISTRY[name].outputs
    if column is None and len(outputs) > 1:
        raise ValueError(f"{name} has several outputs, choose one of {outputs}")
    df = indicators.compute(bars, name, **(params or {})).withColumn("signal", threshold(column or outputs[0], op, value)).select(*bars.columns, "signal")
    return scan_period(df, settings, period, **options) if settings else scan(df, **options)


def edge_json(stats: DataFrame, seen: DataFrame) -> DataFrame:
    """symbol, json: a symbol's scan as one document, from ``scan`` and ``covered``; null for what is not computable, NaN and infinity included.

    ``horizons`` has the statistics of ALL, ``by_group`` those of each other group, by horizon; times are ISO 8601, in UTC.
    """
    kinds = dict(stats.dtypes)
    number = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c)
    row = F.struct("horizon", *map(number, STATS))
    groups = stats.groupBy("symbol", "grp").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    own = F.when(F.col("grp") == "ALL", F.col("rows"))
    others = F.sort_array(F.collect_list(F.when(F.col("grp") != "ALL", F.struct("grp", "rows"))))
    g = groups.groupBy("symbol").agg(F.max(own).alias("horizons"), F.map_from_entries(others).alias("by_group"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias(c)
    doc = F.struct("n_signals", "direction", "deduct_spread", time("covered_start"), time("covered_end"), "horizons", "by_group")
    return seen.join(g, "symbol", "left").select("symbol", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
