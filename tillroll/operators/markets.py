"""Countries: league table, home against the rest, repeat rate, best products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.bands import HOME_MARKET, PRODUCT_PATTERN, is_product, market
from tillroll.functions.metrics import named, sales_by
from tillroll.functions.numbers import count_true, percent, rounded


def country_league(s: DataFrame) -> DataFrame:
    """All countries, largest revenue first."""
    metrics = ["customers", "orders", "quantity", "revenue", "revenue_share_pct", "aov", "revenue_per_customer"]
    return sales_by(s, ["Country"], metrics).orderBy(F.desc("revenue"), "Country")


def home_vs_rest(s: DataFrame, home: str = HOME_MARKET) -> DataFrame:
    metrics = [
        "countries",
        "customers",
        "orders",
        "revenue",
        "revenue_share_pct",
        "aov",
        "revenue_per_customer",
        "units_per_order",
    ]
    split = s.withColumn("market", market(F.col("Country"), home))
    return sales_by(split, ["market"], metrics).orderBy(F.desc("revenue"), "market")


def repeat_rate_by(s: DataFrame, key: str = "Country", min_customers: int = 20) -> DataFrame:
    """Share of customers with several orders per group with enough customers; orders count within the group."""
    repeat = count_true(F.col("orders") > 1)
    customers = F.count(F.lit(1))
    orders = s.groupBy(key, "CustomerID").agg(F.count_distinct("InvoiceNo").alias("orders"))
    return (
        orders.groupBy(key)
        .agg(
            customers.alias("customers"),
            repeat.alias("repeat_customers"),
            rounded(percent(repeat, customers)).alias("repeat_rate_pct"),
        )
        .where(F.col("customers") >= min_customers)
        .orderBy(F.desc("repeat_rate_pct"), key)
    )


def top_products_per_country(
    s: DataFrame, countries: int = 5, n: int = 3, home: str = HOME_MARKET, pattern: str = PRODUCT_PATTERN,
    label: str = "min", names: DataFrame | None = None,
) -> DataFrame:
    """The n best products of each of the largest countries abroad.

    The lines are summed once, by country and product: the countries' totals are sums of those groups, fees included.
    Spark turns the rank filter into a group limit that runs before the shuffle, so even one huge country sends n rows a
    task. Only the names of the best take a second look at the lines.
    """
    sums = s.groupBy("Country", "StockCode").agg(F.sum("Quantity").alias("quantity"), F.sum("Revenue").alias("sold"))
    # what is not abroad, or no product, comes last: a filter would be moved below the grouping and part it in two
    abroad = F.coalesce(F.col("Country") != home, F.lit(False))
    totals = sums.groupBy("Country").agg(F.sum("sold").alias("total"), F.sum("quantity").alias("units"))
    # the last column decides nothing; it keeps both sums, so that the groups are the same for both readers
    largest = totals.orderBy(abroad.desc(), F.desc("total"), "Country", "units").limit(countries).where(abroad)
    product = F.coalesce(is_product(F.col("StockCode"), pattern), F.lit(False))
    place = F.row_number().over(Window.partitionBy("Country").orderBy(product.desc(), F.desc("sold"), "StockCode"))
    # at most countries * n rows
    # null-safe and inner, so that Spark moves neither a filter nor the join below one reader's grouping only
    same = F.col("Country").eqNullSafe(F.col("_country"))
    best = (
        sums.join(F.broadcast(largest.select(F.col("Country").alias("_country"))), same)
        .withColumn("rank_in_country", place)
        .where((F.col("rank_in_country") <= n) & product)
    )
    revenue = rounded(F.col("sold")).alias("revenue")
    detailed = named(best.drop("_country"), s, ["Country", "StockCode"], label, names)
    return detailed.select("Country", "rank_in_country", "StockCode", "description", "quantity", revenue).orderBy(
        "Country", "rank_in_country"
    )


def monthly_home_vs_rest(s: DataFrame, home: str = HOME_MARKET) -> DataFrame:
    at_home = F.sum(F.when(F.col("Country") == home, F.col("Revenue")).otherwise(0))
    abroad = F.sum(F.when(F.col("Country") != home, F.col("Revenue")).otherwise(0))
    return (
        s.groupBy("YearMonth")
        .agg(
            rounded(at_home).alias("uk_revenue"),
            rounded(abroad).alias("international_revenue"),
            rounded(percent(abroad, F.sum("Revenue"))).alias("international_share_pct"),
        )
        .orderBy("YearMonth")
    )


def top_international(s: DataFrame, k: int = 10, home: str = HOME_MARKET) -> DataFrame:
    """The k largest markets abroad: country and revenue."""
    abroad = s.where(F.col("Country") != home)
    return sales_by(abroad, ["Country"], ["revenue"]).orderBy(F.desc("revenue"), "Country").limit(k)
