"""Exponential indicators of a stream of bars, with what the recursion carries kept as state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A state store with transformWithState; to be set before a query starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EMA, RSI = "ema", "rsi"
_OUT = "symbol string, open_time timestamp_ntz, {} double"


class _Carried(StatefulProcessor):
    """A value of state for each symbol: the time of the last bar, how many there were, and what the recursion carries."""

    fields = ""

    def __init__(self, name: str, period: int):
        self.name, self.period = name, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carried", f"last timestamp_ntz, n long, {self.fields}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("open_time")
        last, n, *carried = self.state.get() if self.state.exists() else (None, 0, *self.first)
        if last is not None:
            bars = bars[bars.open_time > pd.Timestamp(last)]
        bars = bars.drop_duplicates("open_time")
        values = []
        for x in bars.mid:
            n += 1
            carried, y = self.step(n, x, *carried)
            values.append(y)
        if values:
            self.state.update((bars.open_time.iloc[-1].to_pydatetime(), n, *carried))
            yield pd.DataFrame({"symbol": key[0], "open_time": bars.open_time, self.name: pd.array(values, "Float64")})

    def close(self) -> None:
        pass


class _Ema(_Carried):
    fields, first = "y double", (0.0,)

    def step(self, n, x, y):
        y = x if n == 1 else y + 2 / (self.period + 1) * (x - y)
        return (y,), y


class _Rsi(_Carried):
    fields, first = "before double, gain double, loss double", (0.0, 0.0, 0.0)

    def step(self, n, x, before, gain, loss):
        if n > 1:
            up, down = max(x - before, 0.0), max(before - x, 0.0)
            gain, loss = (up, down) if n == 2 else (gain + (up - gain) / self.period, loss + (down - loss) / self.period)
        value = None if n <= self.period else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
        return (x, gain, loss), value


def stream_indicator(bars: DataFrame, name: str, period: int | None = None) -> DataFrame:
    """symbol, open_time and the indicator (``ema``, default period 20, or ``rsi``, 14) of a stream of bars, as the batch indicator gives it.

    A symbol's bars must come in the order of time from batch to batch, as ``stream_bars`` emits them; within a batch they are sorted. A bar at or before the
    last one is known already, or too late, and gives no row. State is one row a symbol, whatever its history, and lives in the query's checkpoint. Set
    the configuration ``STORE`` first.
    """
    kinds = {EMA: (_Ema, 20), RSI: (_Rsi, 14)}
    if name not in kinds:
        raise ValueError(f"{name!r} is not streamed, only {sorted(kinds)}")
    kind, default = kinds[name]
    mid = bars.select("symbol", "open_time", ((F.col("bid_close") + F.col("ask_close")) / 2).alias("mid"))
    return mid.groupBy("symbol").transformWithStateInPandas(kind(name, period or default), _OUT.format(name), "append", "none")
