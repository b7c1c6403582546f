"""Calendar and duration expressions (SF4, SF5, SF22, SF23). All built-in, codegen-friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_week(ts) -> Column:
    """Start (a date) of the Sunday-to-Saturday week holding ``ts``.

    ``date_trunc('week')`` starts weeks on Monday, so it is not used.
    """
    d = F.to_date(_c(ts))
    return F.date_sub(d, F.dayofweek(d) - 1)


def as_date(ts) -> Column:
    return F.to_date(_c(ts))


def as_month(ts) -> Column:
    return F.trunc(F.to_date(_c(ts)), "MM")


def as_quarter(ts) -> Column:
    return F.trunc(F.to_date(_c(ts)), "quarter")


def micros_between(later, earlier) -> Column:
    return F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))


def ceil_hours_between(later, earlier) -> Column:
    """``ceil(seconds / 3600)`` of the difference, as the study bins event delays."""
    return F.ceil(micros_between(later, earlier) / F.lit(float(HOUR_US)))


def within_hours(later, earlier, hours: float, lower_hours: float | None = None) -> Column:
    """``ceil(hours between) <= hours`` with no lower bound unless one is given.

    For an integer bound, ``ceil(x) <= h`` equals ``x <= h``, so the test runs on
    exact microseconds and never rounds.
    """
    d = micros_between(later, earlier)
    cond = d <= F.lit(int(hours * HOUR_US))
    if lower_hours is not None:
        cond = cond & (d >= F.lit(int(lower_hours * HOUR_US)))
    return cond


def seconds_of_day(ts) -> Column:
    t = _c(ts)
    return F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)


def circular_diff(d, period: float) -> Column:
    """Difference wrapped into [-period/2, period/2)."""
    return F.pmod(_c(d) + F.lit(period / 2.0), F.lit(float(period))) - F.lit(period / 2.0)


def to_local(ts, zone: str) -> Column:
    return F.from_utc_timestamp(_c(ts), zone)


def hour_of_week(ts, zone: str | None = None) -> Column:
    """Monday = 0 day index times 24 plus the hour, in ``zone`` when given."""
    t = to_local(ts, zone) if zone else _c(ts)
    return F.weekday(t) * 24 + F.hour(t)


def truncate_seconds(ts) -> Column:
    return F.date_trunc("second", _c(ts))
