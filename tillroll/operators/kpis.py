"""Headline figures and descriptive statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.numbers import count_true, percent, rank_key, ratio, rounded, scale_of
from tillroll.functions.metrics import BASE, DISTINCT, LINES, measured, n_lines, sales_by
from tillroll.operators.ranks import rows_at_ranks

MIDDLE = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor((n + 2) / 2)}


def per_customer(s: DataFrame, *keys: str) -> DataFrame:
    """Orders, revenue and quantity of every customer (within ``keys``)."""
    return s.groupBy(*keys, "CustomerID").agg(
        F.count_distinct("InvoiceNo").alias("orders"),
        F.sum("Revenue").alias("revenue"),
        F.sum("Quantity").alias("quantity"),
    )


def per_order(s: DataFrame) -> DataFrame:
    """Value, units and lines of every order; partial sums make one shuffle of one row per order and task."""
    return s.groupBy("InvoiceNo").agg(
        F.sum("Revenue").alias("order_value"),
        F.sum("Quantity").alias("units"),
        n_lines(s).alias("lines"),
    )


def headline_kpis(s: DataFrame, approx: bool = False) -> DataFrame:
    """The 13 headline figures; ``approx`` replaces the exact distinct counts by sketches, which shuffle nothing."""
    if approx:
        base = s.agg(
            *[F.approx_count_distinct(DISTINCT[m]).alias(m) for m in ("orders", "customers", "products", "countries")],
            n_lines(s).alias(LINES),
            *[BASE[m]().alias(m) for m in ("quantity", "revenue")],
        )
    else:
        # products vary within an order: counted apart, so that everything else can be summed per order first
        products = s.agg(F.count_distinct("StockCode")).scalar()
        base = measured(s, [], ["line_items", "orders", "customers", "countries", "quantity", "revenue"])
        base = base.withColumn("products", products)

    def per(a: str, b: str, name: str) -> Column:
        return rounded(ratio(F.col(a), F.col(b))).alias(name)

    return base.select(
        "line_items",
        F.col("orders").alias("total_orders"),
        F.col("customers").alias("total_customers"),
        F.col("products").alias("total_products"),
        F.col("countries").alias("total_countries"),
        F.col("quantity").alias("quantity_sold"),
        rounded(F.col("revenue")).alias("total_revenue"),
        per("revenue", "orders", "avg_order_value"),
        per("revenue", "quantity", "avg_selling_price"),
        per("revenue", "customers", "revenue_per_customer"),
        per("orders", "customers", "orders_per_customer"),
        per("line_items", "orders", "lines_per_order"),
        per("quantity", "orders", "units_per_order"),
    )


def repeat_kpis(s: DataFrame) -> DataFrame:
    """Customers with several orders against those with one."""
    repeat = F.col("orders") > 1
    n = F.count(F.lit(1))
    return per_customer(s).agg(
        n.alias("customers"),
        count_true(repeat).alias("repeat_customers"),
        count_true(F.col("orders") == 1).alias("one_time_customers"),
        rounded(percent(count_true(repeat), n)).alias("repeat_rate_pct"),
        rounded(percent(F.sum(F.when(repeat, F.col("revenue"))), F.sum("revenue"))).alias("revenue_share_from_repeat_pct"),
    )


def yearly_sales(s: DataFrame) -> DataFrame:
    return sales_by(s, ["Year"], ["orders", "customers", "quantity", "revenue", "revenue_share_pct"]).orderBy("Year")


def _described(
    df: DataFrame, columns: Mapping[str, str], variance: bool, aggregated: bool, digits: int | None = None
) -> DataFrame:
    """min, mean, exact median, max (and population variance) of several columns, one row per column.

    ``digits`` rounds min, median and max; without it min and max are as stored and the median has six digits.

    The plain statistics take one aggregation. Spark's exact ``median`` would hold every distinct value in one task, so
    the two middle rows are found by counting instead; missing values take no part.
    """
    parts = []
    for c in columns.values():
        parts += [F.count(c), F.sum(c), F.min(c), F.max(c), *([F.var_pop(F.col(c).cast("double"))] if variance else [])]
    step = 5 if variance else 4
    plain = df.agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)])

    def shown(x: Column) -> Column:
        return x.cast("double") if digits is None else rounded(x, digits)

    rows = [
        F.struct(
            F.lit(label).alias("metric"),
            shown(F.col(f"_{i * step + 2}")).alias("min_val"),
            rounded(ratio(F.col(f"_{i * step + 1}"), F.col(f"_{i * step}"))).alias("mean_val"),
            shown(F.col(f"_{i * step + 3}")).alias("max_val"),
            *([rounded(F.col(f"_{i * step + 4}")).alias("variance")] if variance else []),
        )
        for i, label in enumerate(columns)
    ]
    plain = plain.select(F.inline(F.array(*rows)))

    scales = {label: scale_of(df, c) for label, c in columns.items()}
    keys = {label: rank_key(df, c) for label, c in columns.items()}
    if aggregated:  # sums may outgrow BIGINT
        keys = {label: key.cast("decimal(38,0)") for label, key in keys.items()}
    values = [F.struct(F.lit(label).alias("metric"), key.alias("value")) for label, key in keys.items()]
    ranked = df.select(F.inline(F.array(*values))).where(F.col("value").isNotNull())
    middle = rows_at_ranks(ranked, ["value"], MIDDLE, by=["metric"], merge_equal=aggregated)
    unit = F.create_map(*[F.lit(x) for label, scale in scales.items() for x in (label, 2 * 10**scale)])[F.col("metric")]
    medians = middle.groupBy("metric").agg(F.sum("value").alias("middle")).withColumn("unit", unit)

    described = plain.join(F.broadcast(medians), "metric", "left")
    median = rounded(ratio(F.col("middle"), F.col("unit")), 6 if digits is None else digits).alias("median_val")
    return described.select("metric", "min_val", "mean_val", median, "max_val", *(["variance"] if variance else []))


def describe_measures(s: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Statistics of the lines."""
    return _described(s, columns or {c: c for c in ("Quantity", "UnitPrice", "Revenue")}, True, aggregated=False)


def describe_orders(s: DataFrame) -> DataFrame:
    """Statistics of the orders: value, units, lines."""
    columns = {"Order value": "order_value", "Units per order": "units", "Lines per order": "lines"}
    return _described(per_order(s), columns, variance=False, aggregated=True, digits=2)
