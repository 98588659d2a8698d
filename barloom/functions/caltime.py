"""Market calendar as column expressions: sessions, holidays, trading days. Inputs are UTC wall clock (TIMESTAMP_NTZ)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKYO, LONDON, NEW_YORK = "Asia/Tokyo", "Europe/London", "America/New_York"
#: Zone, and the local hour at which a trading day begins.
CONVENTIONS = {"ny": (NEW_YORK, 17), "jst": (TOKYO, 0)}


def ensure_utc_timestamp(t: datetime) -> datetime:
    """An aware datetime as naive UTC; a naive one is refused, as its zone is unknown."""
    if t.tzinfo is None:
        raise ValueError(f"naive datetime {t!r}: give it a time zone")
    return t.astimezone(timezone.utc).replace(tzinfo=None)


def parse_cli_timestamp(text: str) -> datetime:
    """A time from the command line, as naive UTC; without an offset it is UTC already."""
    t = datetime.fromisoformat(text)
    return t if t.tzinfo is None else ensure_utc_timestamp(t)


def convention(name: str) -> tuple[str, int]:
    if name not in CONVENTIONS:
        raise ValueError(f"unknown convention {name!r}, not one of {sorted(CONVENTIONS)}")
    return CONVENTIONS[name]


def local(t: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def to_utc(wall: Column, zone: str) -> Column:
    """UTC of a local wall clock. Only for hours that daylight saving neither skips nor repeats, such as 17:00 and 00:00."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def localized(wall: Column, zone: str) -> Column:
    """``to_utc`` of any wall clock; one that daylight saving skips or repeats is an error when the plan runs."""
    utc, hour = to_utc(wall, zone), F.expr("interval 1 hour")
    unclear = (local(utc, zone) != wall) | (local(utc - hour, zone) == wall) | (local(utc + hour, zone) == wall)
    message = F.concat(F.lit(f"{zone} skips or repeats "), wall.cast("string"))
    return F.when(unclear, F.raise_error(message).cast("timestamp_ntz")).otherwise(utc)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def midnight(day: Column) -> Column:
    return day.cast("date").cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.expr(f"interval {n} hours")


def local_minutes(t: Column, zone: str) -> Column:
    x = local(t, zone)
    return F.hour(x) * 60 + F.minute(x)


def session_labels(t: Column) -> Column:
    """Half-open local opening hours; where London and New York are both open, the overlap."""
    within = lambda zone, a, b: local_minutes(t, zone).between(a, b - 1)
    tokyo, london, ny = within(TOKYO, 540, 1020), within(LONDON, 480, 990), within(NEW_YORK, 480, 1020)
    return F.when(london & ny, "LDN_NY_OVERLAP").when(ny, "NEWYORK").when(london, "LONDON").when(tokyo, "TOKYO").otherwise("OFF")


def easter(year: Column) -> Column:
    """Easter Sunday of a year of the Gregorian calendar, by the anonymous computus."""
    div = lambda a, b: F.floor(a / b).cast("int")

    def of(y: Column) -> Column:
        golden, century, rest = y % 19, div(y, 100), y % 100
        epact = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30

        def with_epact(e: Column) -> Column:
            weekday = (32 + 2 * (century % 4) + 2 * div(rest, 4) - e - rest % 4) % 7
            days = lambda w: e + w - 7 * div(golden + 11 * e + 22 * w, 451) + 114
            return let(let(weekday, days), lambda d: F.make_date(y, div(d, 31), d % 31 + 1))

        return let(epact, with_epact)

    return let(year.cast("int"), of)


def good_friday(year: Column) -> Column:
    return F.date_sub(easter(year), 2)


def fx_holidays(year: Column) -> Column:
    """New Year, Good Friday and Christmas: the days on which the market is shut everywhere."""
    return F.array(F.make_date(year, F.lit(1), F.lit(1)), good_friday(year), F.make_date(year, F.lit(12), F.lit(25)))


def _is_holiday(day: Column) -> Column:
    """Whether a local date is a holiday. Easter is worked out on Fridays of spring only."""
    friday = (F.weekday(day) == 4) & F.month(day).isin(3, 4)
    return (F.month(day) * 100 + F.dayofmonth(day)).isin(101, 1225) | (friday & (day == good_friday(F.year(day))))


def is_fx_holiday(t: Column) -> Column:
    return let(local(t, NEW_YORK).cast("date"), _is_holiday)


def is_market_open(t: Column) -> Column:
    """Shut: Saturday; Sunday before and Friday from 17:00 New York; holidays by New York date."""

    def is_open(x: Column) -> Column:
        day, hour = F.weekday(x), F.hour(x)
        shut = (day == 5) | ((day == 6) & (hour < 17)) | ((day == 4) & (hour >= 17))
        return ~(shut | let(x.cast("date"), _is_holiday))

    return let(local(t, NEW_YORK), is_open)


def is_open_during(t: Column, minutes: int) -> Column:
    """Whether the market is open at the first or the last minute of a slot."""
    if minutes <= 1:
        return is_market_open(t)
    return is_market_open(t) | is_market_open(t + F.expr(f"interval {minutes - 1} minutes"))


def trading_day_start(t: Column, name: str) -> Column:
    """UTC start of the trading day that holds ``t``, by wall clock: days of 23 to 25 hours around changes of the clock."""
    zone, hour = convention(name)
    return to_utc(midnight(local(t, zone) - hours(hour)) + hours(hour), zone)


def local_trading_date(t: Column, name: str) -> Column:
    """Local date that names the trading day: that of most of it, so Sunday 17:00 New York belongs to Monday."""
    zone, hour = convention(name)
    return (local(t, zone) + hours((24 - hour) % 24)).cast("date")


def trading_day_label(t: Column, name: str) -> Column:
    """UTC instant of local midnight of the trading date."""
    zone, _ = convention(name)
    return to_utc(midnight(local_trading_date(t, name)), zone)


def trading_period_start(day: Column, name: str) -> Column:
    """UTC start of the trading day of a local date; the inverse of ``local_trading_date``."""
    zone, hour = convention(name)
    return to_utc(midnight(day) - hours((24 - hour) % 24), zone)


def week_key(day: Column) -> Column:
    """Monday of the week of a local trading date."""
    return F.date_sub(day, F.weekday(day))
