"""The registry of indicators: functions that add columns to bars and see only the rows up to each bar."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Indicator:
    """``fn(bars, keys, **params)`` returns ``bars`` with the columns ``outputs``; ``keys`` tell series apart."""

    name: str
    outputs: tuple[str, ...]
    fn: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)


REGISTRY: dict[str, Indicator] = {}


def indicator(name: str, *outputs: str, **defaults):
    """Register a function under ``name``; its output columns are ``outputs``, or the name."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"indicator {name!r} is registered already")
        REGISTRY[name] = Indicator(name, outputs or (name,), fn, defaults)
        return fn

    return add


def compute(bars: DataFrame, name: str, keys: tuple[str, ...] = ("symbol",), **params) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown indicator {name!r}, not one of {sorted(REGISTRY)}")
    it = REGISTRY[name]
    return it.fn(bars, list(keys), **(it.defaults | params))


def mid(name: str = "close") -> Column:
    return (F.col(f"bid_{name}") + F.col(f"ask_{name}")) / 2


def full(value: Callable[[Column], Column], x: Column, w, period: int) -> Column:
    """An aggregate over the last ``period`` rows, null until so many of them have a value."""
    last = w.rowsBetween(-(period - 1), 0)
    return F.when(F.count(x).over(last) == period, value(x).over(last))
