"""Dates as column expressions. Timestamps are TIMESTAMP_NTZ in UTC, months are DATE."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from declarium.schema import MONTH_NAMES

# An offset other than Z at the end of an ISO time.
OFFSET = r"\d[+-]\d{2}:?\d{2}$"


def as_date(value: date | datetime | str) -> date:
    if isinstance(value, datetime):
        return value.date()
    return value if isinstance(value, date) else date.fromisoformat(value[:10])


def month_floor(value: date | datetime | str) -> date:
    return as_date(value).replace(day=1)


def shift_month(month: date, months: int) -> date:
    years, index = divmod(month.year * 12 + month.month - 1 + months, 12)
    return date(years, index + 1, 1)


def next_month(value: date | datetime | str) -> date:
    """First month a forecast made on this day covers."""
    return shift_month(month_floor(value), 1)


def parse_utc(text: Column) -> Column:
    """ISO text to UTC wall-clock time, NULL if unreadable, whatever the session's zone."""
    with_offset = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(text.rlike(OFFSET), with_offset).otherwise(text.try_cast("timestamp_ntz"))


def month_start(when: Column) -> Column:
    return F.trunc(when.cast("date"), "MM")


def month_name(when: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    # element_at answers a NULL index with a name, so undated rows are kept out of it.
    return F.when(when.isNotNull(), F.element_at(names, F.month(when)))


def month_text(when: Column) -> Column:
    """``YYYY-MM``, which sorts by time."""
    return F.substring(when.cast("date").cast("string"), 1, 7)


def date_key(when: Column) -> Column:
    """``YYYYMMDD`` as an integer."""
    return F.year(when) * 10000 + F.month(when) * 100 + F.dayofmonth(when)


def months_between(later: Column, earlier: Column) -> Column:
    """Whole months from one month start to another."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def previous_month_number(month_number: Column) -> Column:
    return F.pmod(month_number - 2, F.lit(12)) + 1


def next_month_number(month_number: Column) -> Column:
    return F.pmod(month_number, F.lit(12)) + 1
