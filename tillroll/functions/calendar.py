"""Calendar columns. Names come from a lookup array: much cheaper per row than formatting a date."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# English month and weekday names, Monday first.
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _names(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def month_name(day: Column) -> Column:
    return F.get(_names(MONTHS), F.month(day) - 1)


def weekday_name(day: Column) -> Column:
    return F.get(_names(WEEKDAYS), F.weekday(day))


def weekday_position(name: Column) -> Column:
    """1 for Monday … 7 for Sunday; 0 for any other text."""
    return F.array_position(_names(WEEKDAYS), name)


def year_month(day: Column) -> Column:
    """'yyyy-MM', put together from two numbers: cheaper per row than formatting a date."""
    month = F.month(day)
    return F.concat(F.year(day).cast("string"), F.when(month < 10, "-0").otherwise("-"), month.cast("string"))


def month_label(number: Column) -> Column:
    """'yyyy-MM' of a number of months since year 0."""
    month = F.pmod(number - 1, F.lit(12)) + 1
    year = F.floor((number - 1) / 12).cast("string")
    return F.concat(F.lpad(year, 4, "0"), F.when(month < 10, "-0").otherwise("-"), month.cast("string"))


def month_number(yyyy_mm: Column) -> Column:
    """Months since year 0 of a 'yyyy-MM' text, so that differences are whole months."""
    return F.substring(yyyy_mm, 1, 4).cast("int") * 12 + F.substring(yyyy_mm, 6, 2).cast("int")
