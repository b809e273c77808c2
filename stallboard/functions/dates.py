"""Date and time column functions (I1-I13) and driver-side date ranges.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_key(ts) -> Column:
    """I1: 'YYYY-MM' of a timestamp."""
    return F.date_format(_c(ts), "yyyy-MM")


def month_label(month) -> Column:
    """I2: 'yyyy-MM' text -> short month name ('Jan')."""
    return F.date_format(F.to_date(_c(month), "yyyy-MM"), "MMM")


def order_date(ts) -> Column:
    """Calendar date of a timestamp."""
    return F.to_date(_c(ts))


def hour_of(ts) -> Column:
    """I4."""
    return F.hour(_c(ts))


def iso_weekday(d) -> Column:
    """Monday=1 .. Sunday=7 (``dayofweek`` would give Sunday=1)."""
    return F.weekday(_c(d)) + 1


def weekday0(d) -> Column:
    """Monday=0 .. Sunday=6."""
    return F.weekday(_c(d))


def date_parts(d) -> dict[str, Column]:
    """I5 + I7: the calendar features of the quantity models."""
    d = _c(d)
    return {
        "weekday": iso_weekday(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "year": F.year(d),
        "day_of_year": F.dayofyear(d),
    }


def is_weekend(d, weekend_from: int = 5) -> Column:
    """I8: ISO weekday >= ``weekend_from``; the default 5 counts Friday, as the reference does."""
    return (iso_weekday(d) >= weekend_from).cast("byte")


def promo_flag(d) -> Column:
    """1 on days 10, 20, 30 of a month."""
    return (F.dayofmonth(_c(d)) % 10 == 0).cast("int")


def seconds_between(start, end) -> Column:
    """``end - start`` in whole seconds (negative when end precedes start)."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def order_durations(df):
    """I10 over orders with their four times: seconds to the driver's arrival, from there to pickup, from there to
    delivery; null where either time is missing."""
    return df.withColumns({
        "time_to_arrive": seconds_between("order_time", "driver_arrival_time"),
        "wait_to_pickup": seconds_between("driver_arrival_time", "driver_pickup_time"),
        "delivery_duration": seconds_between("driver_pickup_time", "delivery_time"),
    })


def start_of_day(ts) -> Column:
    """Midnight of a date or timestamp, as a zone-less timestamp."""
    return F.date_trunc("DAY", _c(ts).cast("timestamp_ntz"))


def end_of_day(ts) -> Column:
    """Last microsecond of the day, as a zone-less timestamp."""
    return start_of_day(ts) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")


def date_sequence(start, days: int) -> Column:
    """Array of ``days`` consecutive dates from ``start``; explode to rows."""
    s = _c(start)
    return F.sequence(s, F.date_add(s, days - 1), F.expr("INTERVAL 1 DAY"))


def fmt_day(d) -> Column:
    """I13: '%Y-%m-%d'."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def fmt_minute(ts) -> Column:
    """I13: 'YYYY-MM-DD HH:mm'."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


def fmt_month_day(d) -> Column:
    """I13: 'MM-DD'."""
    return F.date_format(_c(d), "MM-dd")


# ---------------------------------------------------------------- driver-side ranges

def ntz_lit(x: dt.datetime) -> Column:
    """A zone-less timestamp literal; unlike ``lit(datetime)`` it does not pass through the
    Python process's or the session's time zone."""
    return F.expr(f"TIMESTAMP_NTZ '{x.isoformat(sep=' ')}'")


def as_date(x) -> dt.date:
    if isinstance(x, dt.datetime):
        return x.date()
    if isinstance(x, dt.date):
        return x
    return dt.date.fromisoformat(str(x)[:10])


def check_days(days: int, lo: int = 1, hi: int = 365) -> int:
    """Argument guard, raised before anything is planned."""
    days = int(days)
    if not lo <= days <= hi:
        raise ValueError(f"days must be between {lo} and {hi}, got {days}")
    return days


def lookback_bounds(as_of, days: int) -> tuple[dt.datetime, dt.datetime]:
    """Closed range of ``days`` calendar days ending at ``as_of``.

    From 00:00:00 of ``as_of - (days-1)`` to 23:59:59.999999 of ``as_of``, both inclusive.
    """
    days = check_days(days)
    end = as_date(as_of)
    hi = dt.datetime.combine(end, dt.time(23, 59, 59, 999999))
    lo = dt.datetime.combine(end - dt.timedelta(days=days - 1), dt.time(0, 0))
    return lo, hi


def training_cutoff(cutoff) -> tuple[dt.datetime, dt.date]:
    """Half-open bound ``order_time < cutoff + 1 day`` and the date bound ``<= cutoff``."""
    c = as_date(cutoff)
    return dt.datetime.combine(c + dt.timedelta(days=1), dt.time(0, 0)), c
