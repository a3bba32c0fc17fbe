"""Reporting marts: the frames a dashboard reads. They hold one row per month, customer, product or country."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.functions.bands import customer_type
from tillroll.functions.metrics import BASE, base_of, measured_and_usual, sales_by, shown, with_name
from tillroll.operators.customers import rfm


def mart_monthly(s: DataFrame) -> DataFrame:
    keys = ["YearMonth", "Year", "MonthNum", "MonthName"]
    return sales_by(s, keys, ["orders", "customers", "quantity", "revenue", "aov"])


def mart_customer(s: DataFrame) -> DataFrame:
    metrics = ["orders", "quantity", "revenue", "aov"]
    customers = s.groupBy("CustomerID").agg(
        F.min("InvoiceDay").alias("first_purchase"),
        F.max("InvoiceDay").alias("last_purchase"),
        *[BASE[m]().alias(m) for m in base_of(metrics)],
    )
    return with_name(customers, s, "CustomerID", "Country", "Country").select(
        "CustomerID",
        "Country",
        "first_purchase",
        "last_purchase",
        *[shown(m) for m in metrics],
        customer_type(F.col("orders")).alias("customer_type"),
    )


def mart_product(s: DataFrame, label: str = "min", names: DataFrame | None = None) -> DataFrame:
    """Every code, fees included; ``label`` and ``names`` as for rankings of products."""
    metrics = ["orders", "customers", "quantity", "revenue", "avg_selling_price"]
    if names is None and label == "mode":
        products = measured_and_usual(s, "StockCode", metrics, "Description")
        return products.select("StockCode", "Description", *[shown(m) for m in metrics])
    products = sales_by(s, ["StockCode"], metrics)
    source = s if names is None else names
    return with_name(products, source, "StockCode", "Description", "Description", label).select("StockCode", "Description", *metrics)


def mart_country(s: DataFrame) -> DataFrame:
    return sales_by(s, ["Country"], ["customers", "orders", "quantity", "revenue", "aov"])


# view name -> the mart behind it
MARTS = {
    "vw_rfm": rfm,
    "vw_monthly_sales": mart_monthly,
    "vw_customer_summary": mart_customer,
    "vw_product_summary": mart_product,
    "vw_country_summary": mart_country,
}


def register_views(spark: SparkSession, s: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Create the five temporary views; like any view they are computed when read, unless a ``path`` stores them."""
    marts = write_marts(s, path) if path else {name: build(s) for name, build in MARTS.items()}
    for name, mart in marts.items():
        mart.createOrReplaceTempView(name)
    return marts


def write_marts(s: DataFrame | Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Write every mart to ``path/<view name>`` as Parquet, replacing what is there, and return them as stored.

    Views compute a mart again for every reader; stored ones are computed once. RFM, the dearest, pays off first.
    ``s`` are the lines, or already the marts by name.
    """
    marts = s if isinstance(s, Mapping) else {name: build(s) for name, build in MARTS.items()}
    spark = next(iter(marts.values())).sparkSession
    stored = {}
    for name, mart in marts.items():
        mart.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
        stored[name] = spark.read.schema(mart.schema).parquet(f"{path.rstrip('/')}/{name}")
    return stored


def mart_counts(marts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of every mart, in one row. Counting needs the group keys only: Spark drops the measures from each plan."""
    counted = {
        "monthly_rows": "vw_monthly_sales",
        "customer_rows": "vw_customer_summary",
        "product_rows": "vw_product_summary",
        "country_rows": "vw_country_summary",
        "rfm_rows": "vw_rfm",
    }
    first, *others = counted.items()
    row = marts[first[1]].agg(F.count(F.lit(1)).alias(first[0]))
    return row.select(
        first[0], *[marts[view].agg(F.count(F.lit(1))).scalar().alias(name) for name, view in others]
    )
