"""Indicators by name. Every module of this package is imported, so none escapes the look-ahead tests."""

from importlib import import_module
from pkgutil import iter_modules

from barloom.operators.indicators.registry import REGISTRY, Indicator, compute, indicator

for _module in iter_modules(__path__):
    import_module(f"{__name__}.{_module.name}")

__all__ = ["REGISTRY", "Indicator", "compute", "indicator"]
