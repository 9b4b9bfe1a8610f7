from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIAL_ORIGIN = "1899-12-30"  # fixed value: day 0 of spreadsheet date serials


def serial_to_date(serial: Column) -> Column:
    """Spreadsheet day number to date; a time-of-day fraction is cut off."""
    return F.date_add(F.lit(SERIAL_ORIGIN).cast("date"), serial.try_cast("int"))


def month_start(code: Column) -> Column:
    """First day of a `yyyymm` (or `yyyy_mm`) month code."""
    return F.to_date(F.replace(code, F.lit("_"), F.lit("")), "yyyyMM")


def month_end(code: Column) -> Column:
    return F.last_day(month_start(code))


def horizon_days(rule: str, first_month: Column, last_month: Column, as_of: Column, order_days: int) -> Column:
    """Days over which the five-month forecast is spread."""
    last = month_end(last_month)
    if rule == "base":
        return F.datediff(last, as_of) - order_days
    if rule == "weekly":
        return F.datediff(last, month_start(first_month))
    if rule == "transfer":
        return F.datediff(last, F.date_add(as_of, order_days))
    raise ValueError(f"unknown horizon rule {rule!r}")
