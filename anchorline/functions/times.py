"""Time expressions on ``timestamp_ntz``, free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(text: Column | str, pattern: str = TIME_FORMAT) -> Column:
    return F.to_timestamp_ntz(_col(text), F.lit(pattern))


def first_time(time: Column | str, date: Column | str) -> Column:
    """The time where known, else the date."""
    return F.coalesce(_col(time).cast("timestamp_ntz"), _col(date).cast("timestamp_ntz"))


def plus_hours(time: Column | str, hours: Column | int) -> Column:
    amount = F.lit(hours) if isinstance(hours, int) else hours
    return _col(time) + F.make_dt_interval(hours=amount)


def plus_days(time: Column | str, days: Column | int) -> Column:
    amount = F.lit(days) if isinstance(days, int) else days
    return _col(time) + F.make_dt_interval(days=amount)


def epoch_hours(time: Column | str) -> Column:
    """Whole hours since 1970, counted on the calendar so that it never goes backwards."""
    time = _col(time)
    return F.unix_date(time.cast("date")) * 24 + F.hour(time)


def age_at(time: Column | str, anchor_year: Column | str, anchor_age: Column | str) -> Column:
    """Whole days since 1 January of the anchor year in years of 365 days, plus the age back then."""
    january = F.make_timestamp_ntz(_col(anchor_year), *[F.lit(v) for v in (1, 1, 0, 0, 0)])
    days = F.extract(F.lit("DAY"), _col(time) - january)
    return (F.floor(days / F.lit(365.0)) + _col(anchor_age)).cast("long")


def whole_hours_between(start: Column | str, end: Column | str) -> Column:
    """Days of the duration times 24 plus its hour field."""
    span = _col(end) - _col(start)
    return (F.extract(F.lit("DAY"), span) * 24 + F.extract(F.lit("HOUR"), span)).cast("long")


def strictly_between(time: Column | str, low: Column, high: Column) -> Column:
    return (_col(time) > low) & (_col(time) < high)
