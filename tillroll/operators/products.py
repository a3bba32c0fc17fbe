"""Products: rankings, price bands, code types.

Rankings name a product by its alphabetically first description, or with ``label='mode'`` by its usual one. ``names`` takes
descriptions from a frame of codes and descriptions instead of the lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.bands import PRICE_EDGES, PRODUCT_PATTERN, amount_band, code_type, is_product
from tillroll.functions.metrics import BASE, details_for, named, occurring, sales_by
from tillroll.functions.numbers import percent, ratio, rounded


def _products(s: DataFrame, pattern: str) -> DataFrame:
    return s.where(is_product(F.col("StockCode"), pattern))


def _ranked(
    s: DataFrame, totals: DataFrame, order: list[Column], k: int, label: str, names: DataFrame | None
) -> DataFrame:
    """The first k products of ``totals``, with their names, in that order."""
    order = [*order, F.col("StockCode")]
    return named(totals.orderBy(order).limit(k), s, ["StockCode"], label, names).orderBy(order)


def top_products_by_revenue(
    s: DataFrame, k: int = 10, pattern: str = PRODUCT_PATTERN, label: str = "min", names: DataFrame | None = None
) -> DataFrame:
    """Top products by revenue; the share is of all revenue, fees and postage included."""
    totals = s.groupBy("StockCode").agg(F.sum("Quantity").alias("quantity"), F.sum("Revenue").alias("sold"))
    # all codes are grouped once, for the total (of all columns, so that the shuffle is reused) and for the ranking, from
    # which others than products are kept by its order: a filter would be moved below the grouping
    total = totals.agg(F.struct(F.sum("sold").alias("sold"), F.sum("quantity").alias("quantity"))).scalar()["sold"]
    product = F.coalesce(is_product(F.col("StockCode"), pattern), F.lit(False))
    order = [product.desc(), F.desc("revenue"), F.col("StockCode")]
    top = totals.withColumn("revenue", rounded(F.col("sold"))).orderBy(order).limit(k).where(product)
    detailed = named(top, s, ["StockCode"], label, names, orders=BASE["orders"]())
    return detailed.orderBy(F.desc("revenue"), "StockCode").select(
        "StockCode",
        "description",
        "quantity",
        "orders",
        "revenue",
        rounded(ratio(F.col("sold"), F.col("quantity"))).alias("avg_selling_price"),
        rounded(percent(F.col("sold"), total)).alias("revenue_share_pct"),
    )


def top_products_by_quantity(
    s: DataFrame, k: int = 10, pattern: str = PRODUCT_PATTERN, label: str = "min", names: DataFrame | None = None
) -> DataFrame:
    metrics = ["quantity", "revenue", "avg_selling_price"]
    totals = sales_by(_products(s, pattern), ["StockCode"], metrics)
    return _ranked(s, totals, [F.desc("quantity")], k, label, names).select("StockCode", "description", *metrics)


def top_products_by_orders(
    s: DataFrame, k: int = 10, pattern: str = PRODUCT_PATTERN, label: str = "min", names: DataFrame | None = None
) -> DataFrame:
    """Products in most orders, with the share of all orders that contain them.

    The lines are grouped once, by product, order and customer; popularity, the customers of the best and the number of
    all orders come from those groups. Only the names of the best take a second look at the lines, at two of their columns.
    """
    sold = occurring(s, ["StockCode", "InvoiceNo", "CustomerID"])
    totals = sold.groupBy("StockCode").agg(F.count_distinct("InvoiceNo").alias("orders_containing"))
    # products are kept by the order, not by a filter, which would be moved below the grouping and part it in two
    product = F.coalesce(is_product(F.col("StockCode"), pattern), F.lit(False))
    order = [F.desc("orders_containing"), F.col("StockCode")]
    top = totals.orderBy(product.desc(), *order).limit(k).where(product)
    all_orders = sold.agg(BASE["orders"]()).scalar()
    penetration = rounded(percent(F.col("orders_containing"), all_orders)).alias("order_penetration_pct")
    buyers = details_for(top, sold, ["StockCode"], {"customers": BASE["customers"]()})
    return named(buyers, s, ["StockCode"], label, names).orderBy(order).select("StockCode", "description", "orders_containing", penetration, "customers")


def bottom_products(
    s: DataFrame, min_quantity: int = 10, k: int = 10, pattern: str = PRODUCT_PATTERN, label: str = "min",
    names: DataFrame | None = None,
) -> DataFrame:
    """Products with the smallest revenue among those that sold at least ``min_quantity`` units."""
    totals = sales_by(_products(s, pattern), ["StockCode"], ["quantity", "revenue"])
    totals = totals.where(F.col("quantity") >= min_quantity)
    return _ranked(s, totals, [F.col("revenue")], k, label, names).select("StockCode", "description", "quantity", "revenue")


def top_products_by_countries(
    s: DataFrame, k: int = 10, pattern: str = PRODUCT_PATTERN, label: str = "min", names: DataFrame | None = None
) -> DataFrame:
    totals = sales_by(_products(s, pattern), ["StockCode"], ["countries", "revenue"])
    top = _ranked(s, totals, [F.desc("countries"), F.desc("revenue")], k, label, names)
    return top.select("StockCode", "description", "countries", "revenue")


def premium_products(
    s: DataFrame, min_average=20, k: int = 10, pattern: str = PRODUCT_PATTERN, label: str = "min",
    names: DataFrame | None = None,
) -> DataFrame:
    """Products whose price, averaged over lines, is at least ``min_average``, dearest first."""
    # summed lines (``plans.grains``) bring sum and number of their prices
    summed = "PricedLines" in s.columns
    total, n = (F.sum("PriceSum"), F.sum("PricedLines")) if summed else (F.sum("UnitPrice"), F.count("UnitPrice"))
    totals = _products(s, pattern).groupBy("StockCode").agg(
        ratio(total, n).alias("price"),
        F.sum("Quantity").alias("quantity"),
        rounded(F.sum("Revenue")).alias("revenue"),
    )
    dear = totals.where(F.col("price") >= min_average).withColumn("avg_unit_price", rounded(F.col("price")))
    top = _ranked(s, dear, [F.desc("avg_unit_price")], k, label, names)
    return top.select("StockCode", "description", "avg_unit_price", "quantity", "revenue")


def price_bands(s: DataFrame, edges: Sequence = PRICE_EDGES, step=0.01) -> DataFrame:
    """Sales by unit price; a product sold at several prices counts in several bands."""
    banded = s.withColumn("price_band", amount_band(F.col("UnitPrice"), edges, step))
    metrics = ["products", "quantity", "revenue", "revenue_share_pct", "quantity_share_pct"]
    return sales_by(banded, ["price_band"], metrics).orderBy("price_band")


def code_type_split(s: DataFrame, pattern: str = PRODUCT_PATTERN) -> DataFrame:
    """Products against fees, postage and manual entries; a missing code is no product."""
    typed = s.withColumn("code_type", code_type(F.col("StockCode"), pattern))
    return sales_by(typed, ["code_type"], ["codes", "line_items", "revenue", "revenue_share_pct"]).orderBy("code_type")
