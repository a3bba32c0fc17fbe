"""Bands, codes and markets as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Literals the result tables must show.
PRODUCT_PATTERN = "^[0-9]{5}"
PRODUCT_LABEL = "Product"
NON_PRODUCT_LABEL = "Non-product (fees/postage/manual)"
HOME_MARKET = "United Kingdom"
INTERNATIONAL_LABEL = "International"
REPEAT_LABEL = "Repeat"
ONE_TIME_LABEL = "One-time"
DAY_PARTS = ("1 Morning (before 12)", "2 Midday (12-14)", "3 Afternoon (15-17)", "4 Evening (18+)")
DAY_PART_HOURS = (12, 15, 18)
PRICE_EDGES = (1, 2, 5, 10, 50)
ORDER_VALUE_EDGES = (100, 250, 500, 1000, 5000)
ORDER_COUNT_TOPS = (1, 2, 5, 10)
BASKET_SIZE_TOPS = (1, 5, 10, 20, 50)


def below(x: Column, edges: Sequence, labels: Sequence[str]) -> Column:
    """The label of the first edge that x lies below, else the last label (also for NULL)."""
    chain = F.when(x < F.lit(edges[0]), labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        chain = chain.when(x < F.lit(edge), label)
    return chain.otherwise(labels[-1])


def amount_labels(edges: Sequence, step) -> list[str]:
    """'1 Under 100', '2 100 - 249', … '6 5,000 and above'; step is the smallest difference shown."""
    inner = [f"{i} {low:,} - {high - step:,}" for i, (low, high) in enumerate(zip(edges, edges[1:]), start=2)]
    return [f"1 Under {edges[0]:,}", *inner, f"{len(edges) + 1} {edges[-1]:,} and above"]


def count_labels(tops: Sequence[int], noun: str) -> list[str]:
    """'1 order', '2 orders', '3-5 orders', … '11+ orders' for inclusive upper bounds."""
    labels = []
    low = 1
    for top in tops:
        span = str(low) if low == top else f"{low}-{top}"
        labels.append(f"{span} {noun}" + ("" if top == 1 else "s"))
        low = top + 1
    return [*labels, f"{low}+ {noun}s"]


def amount_band(x: Column, edges: Sequence, step=1) -> Column:
    return below(x, edges, amount_labels(edges, step))


def count_band(x: Column, tops: Sequence[int], noun: str) -> Column:
    return below(x, [top + 1 for top in tops], count_labels(tops, noun))


def is_product(code: Column, pattern: str = PRODUCT_PATTERN) -> Column:
    return code.rlike(pattern)


def code_type(code: Column, pattern: str = PRODUCT_PATTERN) -> Column:
    return F.when(is_product(code, pattern), PRODUCT_LABEL).otherwise(NON_PRODUCT_LABEL)


def market(country: Column, home: str = HOME_MARKET) -> Column:
    return F.when(country == home, home).otherwise(INTERNATIONAL_LABEL)


def customer_type(orders: Column) -> Column:
    return F.when(orders > 1, REPEAT_LABEL).otherwise(ONE_TIME_LABEL)


def day_part(hour: Column) -> Column:
    return below(hour, DAY_PART_HOURS, DAY_PARTS)
