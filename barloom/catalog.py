"""All queries of the bar library by name, with their SQL."""

from __future__ import annotations

from barloom.queries import bars, calendar, streams, studies

_PARTS = (calendar, bars, studies, streams)
flagship = studies.flagship


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.SQL.items()}
