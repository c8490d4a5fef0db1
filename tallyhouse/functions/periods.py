"""Billing periods in UTC, from epoch milliseconds or ``yyyy-MM`` text."""

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_time(ts_ms: Column) -> Column:
    return F.timestamp_millis(ts_ms)


def billing_month(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM")


def billing_day(ts_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd")


def month_start(period: Column) -> Column:
    return F.to_date(F.concat(period, F.lit("-01")))


def days_in_month(period: Column) -> Column:
    return F.dayofmonth(F.last_day(month_start(period)))


def previous_period(period: str) -> str:
    first = date(int(period[:4]), int(period[5:7]), 1)
    return (first - timedelta(days=1)).strftime("%Y-%m")


def trailing_periods(period: str, months: int) -> list[str]:
    """The ``months`` periods that end with ``period``, oldest first."""
    found = [period]
    while len(found) < months:
        found.append(previous_period(found[-1]))
    return found[::-1]
