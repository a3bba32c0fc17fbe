"""Counts that roll up: a mart by month that keeps a sketch of every counted column beside the exact count.

Distinct counts of months do not add up to those of a quarter or a year: who buys in two months counts once. A
HyperLogLog sketch of the counted values does merge, exactly as if it had been made of all lines at once, so any span of months
can be answered from the mart, a few kilobytes a month, without going back to the lines.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.bands import HOME_MARKET, market
from tillroll.functions.metrics import DISTINCT, LINES, measured, n_lines
from tillroll.functions.numbers import rounded

COUNTED = ("orders", "customers", "products", "countries")
MONTH = ("YearMonth", "Year", "Quarter", "MonthNum", "MonthName")
# 2 ** LG_K registers: the standard error is 1.04 / sqrt(2 ** LG_K), 1.6 % for 12
LG_K = 12


def stated_error(lg_k: int = LG_K, sigmas: float = 3.0) -> float:
    """The relative error that an estimate exceeds in less than 0.3 % of all cases (for three sigmas)."""
    return sigmas * 1.04 / math.sqrt(2**lg_k)


def sketched(s: DataFrame, keys: Sequence[str], counted: Sequence[str] = COUNTED, lg_k: int = LG_K) -> DataFrame:
    """Per group: lines, quantity and revenue (unrounded), exact counts, and ``<name>_sketch`` for each counted column.

    The sketches are partial aggregates of a fixed size: one row a group and task is shuffled for all of them.
    """
    sums = [n_lines(s).alias("_lines"), F.sum("Quantity").alias("_quantity"), F.sum("Revenue").alias("_revenue")]
    made = [F.hll_sketch_agg(DISTINCT[m], F.lit(lg_k)).alias(f"{m}_sketch") for m in counted]
    exact = [f"_{m}" for m in counted]
    groups = s.groupBy(*keys).agg(*sums, *made)
    counts = measured(s, list(keys), counted).withColumnsRenamed({m: f"_{m}" for m in counted} | {k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = groups.join(counts, same) if keys else groups.crossJoin(counts)
    return joined.select(
        *keys,
        F.col("_lines").alias(LINES),
        F.col("_quantity").alias("quantity"),
        F.col("_revenue").alias("revenue"),
        *[F.col(c).alias(c[1:]) for c in exact],
        *[f"{m}_sketch" for m in counted],
    )


def mart_monthly_sketched(s: DataFrame, lg_k: int = LG_K) -> DataFrame:
    return sketched(s, MONTH, lg_k=lg_k)


def mart_country_sketched(s: DataFrame, lg_k: int = LG_K) -> DataFrame:
    return sketched(s, ["Country"], ("orders", "customers", "products"), lg_k)


def rolled_up(mart: DataFrame, keys: Sequence[str | Column] = ()) -> DataFrame:
    """Sums and estimated distinct counts of coarser groups, from a sketched mart; without keys, of everything.

    Sums are exact. ``<name>_estimate`` is off by more than ``stated_error`` of the true count in less than 0.3 % of
    all cases; as long as a few hundred values are counted it is exact or nearly so.
    """
    counted = [c.removesuffix("_sketch") for c in mart.columns if c.endswith("_sketch")]
    merged = mart.groupBy(*keys).agg(
        F.sum(LINES).alias(LINES),
        F.sum("quantity").alias("quantity"),
        rounded(F.sum("revenue")).alias("revenue"),
        *[F.hll_sketch_estimate(F.hll_union_agg(f"{m}_sketch")).alias(f"{m}_estimate") for m in counted],
    )
    return merged


def by_year(mart: DataFrame) -> DataFrame:
    return rolled_up(mart, ["Year"]).orderBy("Year")


def by_quarter(mart: DataFrame) -> DataFrame:
    return rolled_up(mart, ["Year", "Quarter"]).orderBy("Year", "Quarter")


def by_market(mart: DataFrame, home: str = HOME_MARKET) -> DataFrame:
    """Home against the rest, from the mart by country."""
    return rolled_up(mart, [market(F.col("Country"), home).alias("market")]).orderBy("market")


def checked(estimates: DataFrame, exact: DataFrame, keys: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """The exact counts beside whether each estimate keeps within the stated error."""
    counted = [c.removesuffix("_estimate") for c in estimates.columns if c.endswith("_estimate")]
    known = exact.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *counted)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    joined = estimates.join(known, same) if keys else estimates.crossJoin(known)
    off = {m: F.abs(F.col(f"{m}_estimate") - F.col(m)) <= F.lit(stated_error(lg_k)) * F.col(m) for m in counted}
    return joined.select(*keys, LINES, "quantity", "revenue", *counted, *[c.alias(f"{m}_within") for m, c in off.items()])
