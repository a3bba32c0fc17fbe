"""Hand-made sales lines: give the columns that matter, the rest is filled in."""

from __future__ import annotations

import datetime
from decimal import Decimal

from tillroll.functions.calendar import MONTHS, WEEKDAYS
from tillroll.sources.schema import SALES_SCHEMA


def line(invoice="1", code="10001", description="cup", quantity=1, price="1.00", customer=1, country="United Kingdom",
         ts="2011-01-03 10:00", revenue=None):
    at = datetime.datetime.fromisoformat(ts)
    amount = None if price is None or quantity is None else Decimal(price) * quantity
    return (
        invoice, code, description, quantity, None if price is None else Decimal(price), customer, country,
        amount if revenue is None else Decimal(revenue), at.year, (at.month + 2) // 3, MONTHS[at.month - 1],
        WEEKDAYS[at.weekday()], at, at.date(), at.strftime("%Y-%m"), at.month, at.hour,
    )


def sales(spark, lines):
    return spark.createDataFrame(lines, SALES_SCHEMA)


def dicts(df):
    return [row.asDict() for row in df.collect()]
