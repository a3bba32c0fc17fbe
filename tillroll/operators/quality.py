"""Data-quality audit: shape, blanks, duplicates, rules, consistency, cardinality, dependencies, extremes, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.bands import PRODUCT_PATTERN, is_product
from tillroll.functions.calendar import month_name, weekday_name
from tillroll.functions.metrics import n_lines, n_lines_where, with_name
from tillroll.functions.numbers import count_true, percent, rounded

# Columns that make a line: two lines equal in all of them are duplicates.
LINE_KEY = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDateTime", "UnitPrice", "CustomerID", "Country")
TEXT_CHECKED = ("StockCode", "Description", "Country")
# report label -> column
BLANK_CHECKED = {
    "InvoiceNo": "InvoiceNo",
    "StockCode": "StockCode",
    "Description": "Description",
    "Quantity": "Quantity",
    "InvoiceDate": "InvoiceDateTime",
    "UnitPrice": "UnitPrice",
    "CustomerID": "CustomerID",
    "Country": "Country",
    "Revenue": "Revenue",
}


def table_shape(s: DataFrame) -> DataFrame:
    """Rows, invoices, first and last transaction, inclusive number of days between them."""
    return s.agg(
        n_lines(s).alias("total_rows"),
        F.count_distinct("InvoiceNo").alias("distinct_invoices"),
        F.min("InvoiceDateTime").alias("first_transaction"),
        F.max("InvoiceDateTime").alias("last_transaction"),
        (F.date_diff(F.max("InvoiceDay"), F.min("InvoiceDay")) + 1).alias("days_covered"),
    )


def null_blank_counts(
    s: DataFrame, columns: Mapping[str, str] = BLANK_CHECKED, text: Sequence[str] = TEXT_CHECKED
) -> DataFrame:
    """NULLs per column, one row each; for ``text`` columns also empty or all-blank strings. One scan for all."""

    def missing(name: str) -> Column:
        c = F.col(name)
        return c.isNull() | (F.trim(c) == "") if name in text else c.isNull()

    counted = s.agg(*[count_true(missing(name)).alias(f"_{i}") for i, name in enumerate(columns.values())])
    rows = [
        F.struct(F.lit(label).alias("column_name"), F.col(f"_{i}").alias("null_or_blank"))
        for i, label in enumerate(columns)
    ]
    return counted.select(F.inline(F.array(*rows)))


def duplicate_summary(s: DataFrame, keys: Sequence[str] = LINE_KEY) -> DataFrame:
    """Groups of lines equal in all ``keys``, the rows beyond the first of each and the revenue they carry.

    One pass: the row total comes from the same groups, so the lines are shuffled once.
    """
    groups = s.groupBy(*keys).agg(F.max("Revenue").alias("line_revenue"), F.count(F.lit(1)).alias("cnt"))
    repeated = F.col("cnt") > 1
    surplus = F.when(repeated, F.col("cnt") - 1)
    return groups.agg(
        F.count(F.when(repeated, True)).alias("duplicate_groups"),
        F.sum(surplus).alias("surplus_rows"),
        rounded(percent(F.sum(surplus), F.sum("cnt"))).alias("pct_of_rows"),
        rounded(F.sum(surplus * F.col("line_revenue"))).alias("revenue_in_surplus_rows"),
    )


def sales_rules(tolerance: float = 0.01) -> dict[str, Column]:
    """The rules a clean sales line keeps, as conditions that break them."""
    off = F.abs(F.col("Revenue") - F.col("Quantity") * F.col("UnitPrice"))
    return {
        "non_positive_quantity": F.col("Quantity") <= 0,
        "non_positive_price": F.col("UnitPrice") <= 0,
        "non_positive_revenue": F.col("Revenue") <= 0,
        "cancelled_invoices": F.col("InvoiceNo").ilike("C%"),
        "revenue_formula_mismatch": off > F.lit(str(tolerance)).cast("decimal(18,6)"),
    }


def rule_violations(s: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Lines breaking each rule, one column per rule."""
    rules = sales_rules() if rules is None else rules
    return s.agg(*[n_lines_where(s, broken).alias(name) for name, broken in rules.items()])


def calendar_consistency(s: DataFrame) -> DataFrame:
    """Lines whose stored year, quarter, month name or weekday differ from those of their date."""
    day = F.col("InvoiceDay")
    return rule_violations(
        s,
        {
            "year_mismatch": F.col("Year") != F.year(day),
            "quarter_mismatch_calendar": F.col("Quarter") != F.quarter(day),
            "month_name_mismatch": F.coalesce(F.col("MonthName") != month_name(day), F.lit(False)),
            "weekday_mismatch": F.col("WeekdayName") != weekday_name(day),
        },
    )


def cardinality(s: DataFrame, columns: Mapping[str, str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct values per column. ``approx`` swaps the exact count, which shuffles the values, for a fixed-size sketch."""
    columns = columns or {
        "customers": "CustomerID",
        "stock_codes": "StockCode",
        "descriptions": "Description",
        "countries": "Country",
        "months_covered": "YearMonth",
    }
    count = F.approx_count_distinct if approx else F.count_distinct
    return s.agg(*[count(c).alias(label) for label, c in columns.items()])


def nonconforming_codes(s: DataFrame, pattern: str = PRODUCT_PATTERN, names: DataFrame | None = None) -> DataFrame:
    """Codes that do not look like products, largest revenue first; ``names`` as for rankings of products."""
    if names is not None:
        sums = [n_lines(s).alias("line_items"), F.sum("Quantity").alias("qty"), rounded(F.sum("Revenue")).alias("revenue")]
        odd = s.where(~is_product(F.col("StockCode"), pattern)).groupBy("StockCode").agg(*sums)
        described = with_name(odd, names, "StockCode", "Description", "description")
        columns = ["StockCode", "description", "line_items", "qty", "revenue"]
        return described.select(*columns).orderBy(F.desc("revenue"), "StockCode")
    # by code and description first: a text minimum over lines would make Spark sort them
    described = (
        s.where(~is_product(F.col("StockCode"), pattern))
        .groupBy("StockCode", "Description")
        .agg(n_lines(s).alias("n"), F.sum("Quantity").alias("qty"), F.sum("Revenue").alias("revenue"))
    )
    return (
        described.groupBy("StockCode")
        .agg(
            F.min("Description").alias("description"),
            F.sum("n").alias("line_items"),
            F.sum("qty").alias("qty"),
            rounded(F.sum("revenue")).alias("revenue"),
        )
        .orderBy(F.desc("revenue"), "StockCode")
    )


def fd_violations(
    s: DataFrame, key: str = "StockCode", dependent: str = "Description", name: str = "description_variants",
    limit: int | None = 15,
) -> DataFrame:
    """Keys with several values of a column that should depend on them; with ``limit`` the worst ones, else all."""
    found = s.groupBy(key).agg(F.count_distinct(dependent).alias(name)).where(F.col(name) > 1)
    return found if limit is None else found.orderBy(F.desc(name), key).limit(limit)


def fd_violation_counts(
    s: DataFrame, key: str = "InvoiceNo", dependents: Mapping[str, str] | None = None
) -> DataFrame:
    """How many keys have several values of each dependent column.

    'Several' means minimum and maximum differ, so one aggregation without distinct counts settles all columns.
    """
    dependents = dependents or {
        "invoices_with_multiple_timestamps": "InvoiceDateTime",
        "invoices_with_multiple_customers": "CustomerID",
    }
    per_key = s.groupBy(key).agg(
        *[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(label) for label, c in dependents.items()]
    )
    return per_key.agg(*[count_true(F.col(label)).alias(label) for label in dependents])


def fd_violation_detail(s: DataFrame, key: str = "InvoiceNo", dependent: str = "InvoiceDateTime") -> DataFrame:
    """The invoices with several timestamps: customer, number of timestamps, first and last."""
    return (
        s.groupBy(key)
        .agg(
            F.min("CustomerID").alias("CustomerID"),
            F.count_distinct(dependent).alias("timestamps"),
            F.min(dependent).alias("first_ts"),
            F.max(dependent).alias("last_ts"),
        )
        .where(F.col("timestamps") > 1)
        .orderBy(key)
    )


def extreme_rules() -> dict[str, Column]:
    return {
        "Quantity > 1000": F.col("Quantity") > 1000,
        "UnitPrice > 500": F.col("UnitPrice") > 500,
        "Line revenue > 5000": F.col("Revenue") > 5000,
        "UnitPrice < 0.10": F.col("UnitPrice") < F.lit("0.10").cast("decimal(18,4)"),
    }


def flag_extremes(s: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Lines and revenue meeting each condition, one row per condition, all in one scan."""
    rules = extreme_rules() if rules is None else rules
    aggregates = []
    for i, hit in enumerate(rules.values()):
        aggregates += [F.count(F.when(hit, True)).alias(f"_n{i}"), F.sum(F.when(hit, F.col("Revenue"))).alias(f"_r{i}")]
    rows = [
        F.struct(
            F.lit(label).alias("check_name"),
            F.col(f"_n{i}").alias("rows_flagged"),
            rounded(F.col(f"_r{i}")).alias("revenue"),
        )
        for i, label in enumerate(rules)
    ]
    return s.agg(*aggregates).select(F.inline(F.array(*rows)))


def period_coverage(s: DataFrame) -> DataFrame:
    """Rows, first and last day and active days of every month."""
    return (
        s.groupBy("YearMonth")
        .agg(
            n_lines(s).alias("rows_in_month"),
            F.min("InvoiceDay").alias("first_day"),
            F.max("InvoiceDay").alias("last_day"),
            F.count_distinct("InvoiceDay").alias("active_days"),
        )
        .orderBy("YearMonth")
    )


def day_of_month_coverage(s: DataFrame) -> DataFrame:
    """Rows per day of the month and in how many months that day occurs."""
    return (
        s.groupBy(F.dayofmonth("InvoiceDay").alias("day_of_month"))
        .agg(n_lines(s).alias("rows_on_that_day"), F.count_distinct("YearMonth").alias("months_with_data"))
        .orderBy("day_of_month")
    )
