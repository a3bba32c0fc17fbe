"""Sales lines from a TPC-H-like star schema or an event table (the tables the checks run on).

Dimensions are left-joined on their primary keys: a line never gets lost or doubled, and leaving out a dimension whose
columns a query does not use changes nothing but the cost. Join strategies are left to Spark, which broadcasts a
dimension only as long as its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.functions.calendar import month_name, weekday_name, year_month
from tillroll.functions.metrics import kept_whole
from tillroll.functions.numbers import from_cents

HOME = "NATION_0"

# Columns used of each table; a given schema spares Spark a job per table to look it up in the files.
TABLES = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "nation": "n_nationkey INT, n_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _date_columns(ts: Column) -> dict[str, Column]:
    return {
        "InvoiceDateTime": ts,
        "InvoiceDay": ts.cast("date"),
        "YearMonth": year_month(ts),
        "Year": F.year(ts),
        "Quarter": F.quarter(ts),
        "MonthNum": F.month(ts),
        "MonthName": month_name(ts),
        "WeekdayName": weekday_name(ts),
        "HourOfDay": F.hour(ts),
    }


def stock_code(partkey: Column) -> Column:
    """Five digits for a product; every 50th part plays the role of a fee."""
    text = partkey.cast("string")
    padded = F.when(partkey < 100_000, F.lpad(text, 5, "0")).otherwise(text)
    return F.when(partkey % 50 == 0, F.concat(F.lit("FEE"), text)).otherwise(padded)


def sales_lines(
    spark: SparkSession,
    sf_dir: str,
    orders: bool = True,
    countries: bool = False,
    parts: bool = False,
    dated_by: str = "o_orderdate",
    orders_last: bool = False,
) -> DataFrame:
    """Order lines as sales lines.

    ``orders`` adds customer and date columns, ``countries`` (implies orders) the customer's nation, ``parts`` the
    product name. ``dated_by='l_shipdate'`` takes the line's own date instead of the order's. Customer and nation meet
    the orders, not the lines: lines are only ever shuffled by order or product, never by customer, so a customer with a
    third of them does not end up in one task.

    ``orders_last`` is for a reader that groups the lines by order in several ways. They meet the parts first, and the orders last and
    by the text of the invoice number: they then lie dealt by ``InvoiceNo``, and no grouping that has it among its keys shuffles them
    again. They travel as numbers, whole, and dates are made after that, so that all those groupings share the shuffles.
    """
    # amounts arrive as DOUBLE with two decimals; by way of whole cents they become DECIMAL at a fraction of the cost of
    # a direct cast, which goes through text
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    millionths = F.floor(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")) * 1_000_000 + 0.5)
    s = _table(spark, sf_dir, "lineitem")
    own = s.columns
    s = s.withColumns(
        {
            "Quantity": quantity,
            "Revenue": from_cents(cents),
            "UnitPrice": from_cents(F.floor((millionths + 5_000) / 10_000)),
        }
    )
    amounts = s.columns[len(own):]
    part = None
    if parts:
        part = _table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("Description"), F.col("p_brand").alias("Brand")
        )
    if parts and orders_last:
        s = kept_whole(s.join(part, "l_partkey", "left"), ["l_orderkey", "l_partkey", "Quantity", "Revenue", "Description"])
    if orders or countries:
        placed = _table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("CustomerID"), "o_orderdate"
        )
        if countries:
            customer = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("CustomerID"), "c_nationkey")
            nation = _table(spark, sf_dir, "nation").select(
                F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("Country")
            )
            placed = placed.join(customer, "CustomerID", "left").join(nation, "c_nationkey", "left")
        dates = _date_columns(F.col(dated_by))
        if orders_last:
            placed = placed.withColumnRenamed("l_orderkey", "o_orderkey")
            same = F.col("l_orderkey").cast("string") == F.col("o_orderkey").cast("string")
            s = s.join(placed, same, "left").drop("o_orderkey").withColumns(dates)
        elif dated_by == "o_orderdate":
            # once per order instead of once per line
            s = s.join(placed.withColumns(dates), "l_orderkey", "left")
        else:
            s = s.join(placed, "l_orderkey", "left").withColumns(dates)
    if parts and not orders_last:
        s = s.join(part, "l_partkey", "left")
    # texts are made after the joins, which so shuffle the lines as numbers
    texts = {"InvoiceNo": F.col("l_orderkey").cast("string"), "StockCode": stock_code(F.col("l_partkey"))}
    s = s.withColumns(texts)
    first = [c for c in s.columns if c in own]
    rest = [c for c in s.columns if c not in {*own, *texts, *amounts}]
    rest.sort(key=lambda c: c in ("Description", "Brand"))
    return s.select(*first, *texts, *amounts, *rest)


def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """StockCode and Description of every part: names for lines that were not joined with the parts."""
    part = _table(spark, sf_dir, "part")
    return part.select(stock_code(F.col("p_partkey")).alias("StockCode"), F.col("p_name").alias("Description"))


def with_supplier_country(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    """Country of the line's supplier instead of the customer's, so that one customer has several."""
    supplier = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("Country")
    )
    return s.join(supplier, "l_suppkey", "left").join(nation, "s_nationkey", "left")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sales lines of one unit: they have a time of day and heavy-tailed amounts."""
    value = from_cents(F.rint(F.col("value") * 100).cast("bigint"))
    return _table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("InvoiceNo"),
        F.col("event_type").alias("StockCode"),
        F.col("user_id").alias("CustomerID"),
        F.lit(1).cast("bigint").alias("Quantity"),
        value.alias("UnitPrice"),
        value.alias("Revenue"),
        *[c.alias(name) for name, c in _date_columns(F.col("ts")).items()],
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the form of an input file: 13 text columns."""
    s = sales_lines(spark, sf_dir, countries=True, parts=True)
    text = {
        "InvoiceNo": F.col("InvoiceNo"),
        "StockCode": F.col("StockCode"),
        "Description": F.concat(F.lit(" "), F.col("Description"), F.lit("  ")),
        "Quantity": F.col("Quantity").cast("string"),
        "InvoiceDate": F.date_format("InvoiceDateTime", "dd-MM-yyyy HH:mm"),
        "UnitPrice": F.col("UnitPrice").cast("string"),
        "CustomerID": F.col("CustomerID").cast("string"),
        "Country": F.col("Country"),
        "Revenue": F.col("Revenue").cast("string"),
        "Year": F.col("Year").cast("string"),
        "Quarter": F.col("Quarter").cast("string"),
        "Month": F.col("MonthName"),
        "Day": F.col("WeekdayName"),
    }
    return s.select(*[c.alias(name) for name, c in text.items()])
