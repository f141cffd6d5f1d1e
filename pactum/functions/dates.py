"""Obligation clocks on business days (Monday to Friday), in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _since_monday(day: Column) -> Column:
    """Business days from 1970-01-05, a Monday, up to and including day."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)) + 1, F.lit(5))


def add_business_days(day: Column, count: Column) -> Column:
    """The day `count` business days after `day`, which itself counts as 0 and may be on a weekend; null for a negative count."""
    last = F.weekday(day) > 4
    friday = F.when(last, F.date_sub(day, F.weekday(day) - 4)).otherwise(day)
    place = F.weekday(friday) + count
    moved = F.date_add(friday, (F.floor(place / 5) * 7 + F.pmod(place, F.lit(5)) - F.weekday(friday)).cast("int"))
    return F.when(count == 0, day).when(count > 0, moved)


def business_days_between(start: Column, end: Column) -> Column:
    """Signed number of business days after start up to and including end."""
    return (_since_monday(end) - _since_monday(start)).cast("int")


def is_overdue(deadline: Column, as_of: Column) -> Column:
    return as_of > deadline


def grace_period_end(day: Column, days: Column) -> Column:
    return F.when(days >= 0, F.date_add(day, days.cast("int")))


def is_within_window(day: Column, start: Column, end: Column) -> Column:
    return day.between(start, end)


def days_until(day: Column, as_of: Column) -> Column:
    return F.datediff(day, as_of)


def next_on_or_after(day: Column, as_of: Column) -> Column:
    """An aggregate: the earliest day on or after as_of."""
    return F.min(F.when(day >= as_of, day))
