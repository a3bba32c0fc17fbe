"""Sales over time. The windows here run over months, at most some hundred rows, never over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.bands import day_part
from tillroll.functions.calendar import weekday_position
from tillroll.functions.metrics import BASE, details_for, measured, sales_by
from tillroll.functions.numbers import percent, ratio, rounded

IN_TIME = ["YearMonth"]


def _every_month(monthly: DataFrame) -> DataFrame:
    """Add rows, with NULL measures, for the months without sales between the first and the last."""
    first = F.to_date(F.concat(F.min("YearMonth"), F.lit("-01")))
    last = F.to_date(F.concat(F.max("YearMonth"), F.lit("-01")))
    months = monthly.agg(F.sequence(first, last, F.expr("interval 1 month")).alias("m")).select(F.explode("m").alias("m"))
    return months.select(F.date_format("m", "yyyy-MM").alias("YearMonth")).join(monthly, "YearMonth", "left")


def monthly_sales(s: DataFrame, dense_calendar: bool = False) -> DataFrame:
    """Orders, customers, quantity, revenue, AOV per month and growth over the previous month.

    The previous month is the previous one with sales, unless ``dense_calendar`` fills the gaps.
    """
    measures = ["orders", "customers", "quantity", "revenue"]
    monthly = measured(s, IN_TIME, measures)
    if dense_calendar:
        monthly = _every_month(monthly).fillna(0, measures)
    previous = F.lag("revenue").over(Window.orderBy(IN_TIME))
    return monthly.select(
        "YearMonth",
        "orders",
        "customers",
        "quantity",
        rounded(F.col("revenue")).alias("revenue"),
        rounded(ratio(F.col("revenue"), F.col("orders"))).alias("aov"),
        rounded(percent(F.col("revenue") - previous, previous)).alias("mom_growth_pct"),
    ).orderBy(IN_TIME)


def running_and_moving(s: DataFrame, n: int = 3, dense_calendar: bool = False) -> DataFrame:
    """Running total of revenue and its mean over the last ``n`` months (fewer at the start)."""
    monthly = s.groupBy("YearMonth").agg(F.sum("Revenue").alias("revenue"))
    if dense_calendar:
        monthly = _every_month(monthly).fillna(0, ["revenue"])
    months = Window.orderBy(IN_TIME)
    last_n = months.rowsBetween(1 - n, 0)
    return monthly.select(
        "YearMonth",
        rounded(F.col("revenue")).alias("revenue"),
        rounded(F.sum("revenue").over(months)).alias("cumulative_revenue"),
        rounded(ratio(F.sum("revenue").over(last_n), F.count("revenue").over(last_n))).alias(f"moving_avg_{n}m"),
    ).orderBy(IN_TIME)


def quarterly_sales(s: DataFrame) -> DataFrame:
    keys = ["Year", "Quarter"]
    return sales_by(s, keys, ["orders", "quantity", "revenue", "revenue_share_pct"]).orderBy(keys)


def seasonality(s: DataFrame) -> DataFrame:
    """Calendar months over all years, with the average per occurrence of the month."""
    keys = ["MonthNum", "MonthName"]
    return sales_by(s, keys, ["months_in_data", "revenue", "avg_revenue_per_month", "orders"]).orderBy(keys)


def weekday_sales(s: DataFrame) -> DataFrame:
    """Weekdays, Monday first."""
    by_day = sales_by(s, ["WeekdayName"], ["orders", "quantity", "revenue", "revenue_share_pct", "aov"])
    return by_day.orderBy(weekday_position(F.col("WeekdayName")))


def hourly_sales(s: DataFrame) -> DataFrame:
    return sales_by(s, ["HourOfDay"], ["orders", "revenue", "revenue_share_pct"]).orderBy("HourOfDay")


def day_part_sales(s: DataFrame) -> DataFrame:
    parts = s.withColumn("day_part", day_part(F.col("HourOfDay")))
    return sales_by(parts, ["day_part"], ["orders", "revenue", "revenue_share_pct"]).orderBy("day_part")


def best_days(s: DataFrame, k: int = 10) -> DataFrame:
    """The k days with the largest revenue."""
    keys = ["InvoiceDay", "WeekdayName"]
    order = [F.desc("revenue"), *keys]
    top = sales_by(s, keys, ["revenue"]).orderBy(order).limit(k)
    return details_for(top, s, keys, {"orders": BASE["orders"]()}).orderBy(order).select(*keys, "orders", "revenue")


def revenue_per_active_day(s: DataFrame) -> DataFrame:
    return sales_by(s, IN_TIME, ["active_days", "revenue", "revenue_per_active_day"]).orderBy(IN_TIME)


def largest_orders(order_values: DataFrame, k: int = 1) -> DataFrame:
    """The k orders with the largest revenue, from a frame of one or more rows (InvoiceNo, revenue) per order."""
    totals = order_values.groupBy("InvoiceNo").agg(F.sum("revenue").alias("total"))
    # no filter before the limit: it would be moved below the grouping, which then could not be shared with others
    numbered = F.col("InvoiceNo").isNotNull()
    return totals.orderBy(numbered.desc(), F.desc("total"), "InvoiceNo").limit(k).where(numbered).select("InvoiceNo")


def monthly_excluding_top_orders(s: DataFrame, k: int = 1) -> DataFrame:
    """Monthly revenue as it is and without the k largest orders.

    Both readers work on the same revenue per order and month, so the lines are scanned and shuffled once.
    """
    parts = s.groupBy("InvoiceNo", "YearMonth").agg(F.sum("Revenue").alias("revenue"))
    top = largest_orders(parts, k).withColumn("_top", F.lit(True))
    kept = F.col("InvoiceNo").isNotNull() & F.col("_top").isNull()
    return (
        parts.join(F.broadcast(top), "InvoiceNo", "left")
        .groupBy("YearMonth")
        .agg(
            rounded(F.sum("revenue")).alias("revenue_as_provided"),
            rounded(F.sum(F.when(kept, F.col("revenue")).otherwise(0))).alias("revenue_excl_largest_order"),
        )
        .orderBy("YearMonth")
    )
