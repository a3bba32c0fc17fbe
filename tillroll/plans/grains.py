"""Shared sums: the lines summed once per order and once per order and product, from which most reports are derived.

Sums of sums are exact, but distinct counts do not add up: a customer who buys in two months counts once in their total.
A grain therefore keeps every column that its reports count as a key. Counting distinct values of a key over its rows gives
what counting over the lines gives, whatever the report groups by. A column that a grain does not keep cannot be
counted from it: it is not there, and Spark refuses the report. ``control`` compares both grains with the lines.

An operator takes a grain wherever it takes lines: a row stands for the lines summed into it, whose number is in the column
``Lines``. Reports that look at single lines (prices, outliers, duplicates, blanks) read the lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.functions.metrics import LINE_COUNT, kept_whole, n_lines

ORDER_KEYS = (
    "InvoiceNo",
    "CustomerID",
    "Country",
    "InvoiceDateTime",
    "InvoiceDay",
    "YearMonth",
    "Year",
    "Quarter",
    "MonthNum",
    "MonthName",
    "WeekdayName",
    "HourOfDay",
)
ITEM_KEYS = ("InvoiceNo", "CustomerID", "Country", "YearMonth", "StockCode", "Description")
GRAINS = ("orders", "items")
CODES = ("StockCode", "Description")
# what all is made of: lines that keep these columns need the same joins for whatever is counted or summed
TOGETHER = (*CODES, "CustomerID", "Country", "InvoiceDateTime", "Quantity", "Revenue")


@dataclass(frozen=True)
class Grains:
    """The same sales three times: as lines, summed per order, and per order and product."""

    lines: DataFrame
    orders: DataFrame
    items: DataFrame


def order_grain(s: DataFrame, keys: Sequence[str] = ORDER_KEYS) -> DataFrame:
    """One row per order (several where its lines differ in customer, country or time)."""
    sums = [F.sum("Quantity").alias("Quantity"), F.sum("Revenue").alias("Revenue"), n_lines(s).alias(LINE_COUNT)]
    return s.groupBy(*keys).agg(*sums)


def item_grain(s: DataFrame, keys: Sequence[str] = ITEM_KEYS) -> DataFrame:
    """One row per order and product, with what the mean of its line prices needs."""
    prices = [F.sum("UnitPrice").alias("PriceSum"), F.count("UnitPrice").alias("PricedLines")]
    sums = [F.sum("Quantity").alias("Quantity"), F.sum("Revenue").alias("Revenue"), n_lines(s).alias(LINE_COUNT)]
    return s.groupBy(*keys).agg(*sums, *prices)


def grains_of(s: DataFrame, together: bool = False) -> Grains:
    """Both grains as plain, lazy frames: right for a few reports; many should share stored ones.

    ``together`` is for one reader of all three: the order grain is then made from lines that still hold codes and names, as
    the item grain is, and what the lines were joined with is shuffled once for both. Reports on one grain would carry them in vain.
    """
    return Grains(s, order_grain(kept_whole(s, TOGETHER) if together else s), item_grain(s))


def write_grains(s: DataFrame, path: str, months_only: bool = False) -> Grains:
    """Write both grains below ``path``, by month, and return them as stored. The lines are read twice, once for each.

    ``months_only`` replaces the months that occur in ``s`` and leaves all others as they are: sums of a month depend on
    no other month, so that is all a late or corrected month takes.
    """
    for name, grain in (("orders", order_grain(s)), ("items", item_grain(s))):
        # the rebalance hint splits a month that holds most of the rows
        writer = grain.hint("rebalance", "YearMonth").write.mode("overwrite").partitionBy("YearMonth")
        writer.option("partitionOverwriteMode", "dynamic" if months_only else "static").parquet(f"{path.rstrip('/')}/{name}")
    return read_grains(s.sparkSession, path, s)


def read_grains(spark: SparkSession, path: str, lines: DataFrame) -> Grains:
    """Stored grains, beside the lines they were made of."""
    found = []
    for name, grain in (("orders", order_grain(lines)), ("items", item_grain(lines))):
        found.append(spark.read.schema(grain.schema).parquet(f"{path.rstrip('/')}/{name}").select(*grain.columns))
    return Grains(lines, *found)


def control(grains: Grains) -> DataFrame:
    """Lines, quantity, revenue and distinct values of every key, from the lines and from each grain that has them.

    One row per measure; ``agrees`` is false where a grain differs from the lines, as an outdated one would. Codes and names
    are counted apart from what belongs to the order: they need no orders, and which of them occur is the same however rows
    are grouped by them, so that Spark leaves out the joins with orders, and the grouping, of lazy frames.
    """
    counted = {"lines": grains.lines, "orders": grains.orders, "items": grains.items}
    keys = list(dict.fromkeys([*ORDER_KEYS, *ITEM_KEYS]))

    def shown(values: DataFrame) -> DataFrame:
        rows = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("decimal(38,4)").alias("value")) for c in values.columns]
        return values.select(F.inline(F.array(*rows)))

    def measures(s: DataFrame) -> DataFrame:
        own, codes = ([c for c in keys if c in s.columns and (c in CODES) == coded] for coded in (False, True))
        grain = LINE_COUNT in s.columns
        whole = s if grain else kept_whole(s, TOGETHER)
        # orders alone beside the sums are counted where the lines lie, if dealt by order: only the other values move
        together, apart = (own, []) if grain else (["InvoiceNo"], [c for c in own if c != "InvoiceNo"])
        sums = {LINE_COUNT: n_lines(whole), "Quantity": F.sum("Quantity"), "Revenue": F.sum("Revenue")}
        found = whole.agg(*[m.alias(c) for c, m in sums.items()], *[F.count_distinct(c).alias(c) for c in together])
        counts = [frame.agg(*[F.count_distinct(c).alias(c) for c in some]) for frame, some in ((whole, apart), (s, codes)) if some]
        return reduce(DataFrame.union, map(shown, [found, *counts]))

    first, *others = [measures(s).withColumnRenamed("value", name) for name, s in counted.items()]
    joined = first
    for other in others:
        joined = joined.join(other, "measure", "left")
    same = F.lit(True)
    for name in GRAINS:
        same &= F.col(name).isNull() | F.col(name).eqNullSafe(F.col("lines"))
    return joined.withColumn("agrees", same).orderBy("measure")


# which of the three a report needs: all columns it groups by, counts or shows are keys there
READS: Mapping[str, str] = {
    **dict.fromkeys(
        "Q2.1 Q2.5 Q2.9 Q2.10 Q2.12 Q2.13 Q3.2 Q3.3 Q3.5 Q4.1 Q4.2 Q4.3 Q4.4 Q4.5 Q4.6 Q4.7 Q4.8 Q4.9 Q4.10"
        " Q5.1 Q5.2 Q5.3 Q5.4 Q5.5 Q5.6 Q5.7 Q5.9 Q5.10 Q7.1 Q7.2 Q7.3 Q7.5 Q8.1 Q8.2 Q8.7 Q8.10".split(),
        "orders",
    ),
    **dict.fromkeys("Q2.6 Q2.7 Q2.8 Q3.1 Q6.1 Q6.2 Q6.3 Q6.4 Q6.6 Q6.7 Q6.8 Q6.9 Q7.4 Q8.3 Q8.4".split(), "items"),
    **dict.fromkeys("Q2.2 Q2.3 Q2.4 Q2.11 Q3.4 Q6.5 Q8.5 Q8.6 Q8.8 Q8.9".split(), "lines"),
    "Q9.5": "marts",
}
# the same for the marts
MART_READS: Mapping[str, str] = {
    "vw_rfm": "orders",
    "vw_monthly_sales": "orders",
    "vw_customer_summary": "orders",
    "vw_product_summary": "items",
    "vw_country_summary": "orders",
}
