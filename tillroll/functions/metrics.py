"""The semantic layer: every named measure once, so that 'orders' or 'aov' mean the same in every report.

``BASE`` holds aggregates over sales lines, ``DERIVED`` holds values computed from them after grouping. Names are the
column names of the reports.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.numbers import count_true, percent, ratio, rounded

SUMS = {"quantity": "Quantity", "revenue": "Revenue"}
DISTINCT = {
    "orders": "InvoiceNo",
    "customers": "CustomerID",
    "products": "StockCode",
    "codes": "StockCode",
    "countries": "Country",
    "months_in_data": "YearMonth",
    "active_days": "InvoiceDay",
}
# columns that (nearly always) have one value per order
PER_ORDER = {"InvoiceNo", "CustomerID", "Country", "YearMonth", "InvoiceDay"}
LINES = "line_items"
# a frame of summed lines (see ``plans.grains``) holds their number in this column
LINE_COUNT = "Lines"
BASE = {
    **{name: lambda c=c: F.count_distinct(c) for name, c in DISTINCT.items()},
    **{name: lambda c=c: F.sum(c) for name, c in SUMS.items()},
}


def n_lines(s: DataFrame) -> Column:
    """How many sales lines a group has: rows, or the lines that went into rows already summed."""
    return F.coalesce(F.sum(LINE_COUNT), F.lit(0)) if LINE_COUNT in s.columns else F.count(F.lit(1))


def n_lines_where(s: DataFrame, condition: Column) -> Column:
    """Lines for which the condition holds; NULL when it is NULL for every one, as for ``count_true``."""
    return F.sum(condition.cast("int") * F.col(LINE_COUNT)) if LINE_COUNT in s.columns else count_true(condition)


def _over_all(name: str) -> Column:
    return F.sum(name).over(Window.partitionBy())


# name -> (base measures it needs, expression over the grouped frame)
DERIVED = {
    "aov": (("revenue", "orders"), lambda: ratio(F.col("revenue"), F.col("orders"))),
    "asp": (("revenue", "quantity"), lambda: ratio(F.col("revenue"), F.col("quantity"))),
    "avg_selling_price": (("revenue", "quantity"), lambda: ratio(F.col("revenue"), F.col("quantity"))),
    "revenue_per_customer": (("revenue", "customers"), lambda: ratio(F.col("revenue"), F.col("customers"))),
    "avg_revenue_per_month": (("revenue", "months_in_data"), lambda: ratio(F.col("revenue"), F.col("months_in_data"))),
    "revenue_per_active_day": (("revenue", "active_days"), lambda: ratio(F.col("revenue"), F.col("active_days"))),
    "units_per_order": (("quantity", "orders"), lambda: ratio(F.col("quantity"), F.col("orders"))),
    "revenue_share_pct": (("revenue",), lambda: percent(F.col("revenue"), _over_all("revenue"))),
    "quantity_share_pct": (("quantity",), lambda: percent(F.col("quantity"), _over_all("quantity"))),
}

ONE_DECIMAL = {"units_per_order"}
MONEY = {"revenue"}


def base_of(metrics: Iterable[str]) -> list[str]:
    """Base measures needed for the metrics, each once, in order of first use."""
    needed: dict[str, None] = {}
    for name in metrics:
        for part in DERIVED[name][0] if name in DERIVED else (name,):
            needed[part] = None
    return list(needed)


def shown(name: str) -> Column:
    """A metric as it appears in a report: money and ratios rounded, counts as they are."""
    if name in DERIVED:
        return rounded(DERIVED[name][1](), 1 if name in ONE_DECIMAL else 2).alias(name)
    return rounded(F.col(name)).alias(name) if name in MONEY else F.col(name)


def measured(s: DataFrame, keys: list[str], metrics: Iterable[str]) -> DataFrame:
    """Base measures per group of ``keys``, unrounded, in one pass over the lines.

    Spark counts several distinct columns by copying every row once per column. Where all of them belong to the order,
    lines are therefore first summed per order, which also shrinks them before they are shuffled. All distinct counts
    are grouped by (keys + counted column) first, so a key holding a third of the lines is spread over all tasks.
    """
    base = base_of(metrics)
    counted = {DISTINCT[m] for m in base if m in DISTINCT}
    # sums per order and product would be as many as the lines
    if len(counted) > 1 and "InvoiceNo" in counted and counted <= PER_ORDER and "StockCode" not in keys:
        grain = [*keys, *sorted(counted - set(keys))]
        partial = [F.sum(c).alias(c) for m, c in SUMS.items() if m in base]
        if LINES in base:
            partial.append(n_lines(s).alias("_lines"))
        s = s.groupBy(*grain).agg(*partial) if partial else s.select(*grain).distinct()
        lines = F.coalesce(F.sum("_lines"), F.lit(0))
    else:
        lines = n_lines(s)
    return s.groupBy(*keys).agg(*[(lines if m == LINES else BASE[m]()).alias(m) for m in base])


def occurring(s: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct values of ``keys``, grouped once for all that is derived from them.

    Spark drops a plain ``distinct`` below a grouping that can do without, and so reads the lines anew for each of several
    groupings. The (always true) condition on the number of lines keeps it, and its shuffle is then shared.
    """
    return s.groupBy(*keys).agg(n_lines(s).alias("_n")).where("_n > 0").drop("_n")


def sales_by(s: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Named metrics per group of ``keys``, as reported.

    Shares are taken from the grouped rows: use them with keys of limited cardinality only (months, countries, bands);
    rankings of customers or products take their total from a scalar subquery instead.
    """
    return measured(s, keys, metrics).select(*keys, *[shown(m) for m in metrics])


def details_for(
    top: DataFrame, s: DataFrame, keys: list[str], details: Mapping[str, Column], also: Iterable[str] = ()
) -> DataFrame:
    """Add aggregates (name -> expression) to the few rows of ``top``, found by ``keys``; per value of ``also``, if given.

    A ranking needs no name and no distinct count of the entities it drops: those are taken afterwards, over the lines
    of the ranked entities only. It also keeps text out of the ranking's aggregation, which Spark would else do by
    sorting all lines instead of hashing them. ``top`` must come from a ``limit``: it is broadcast.
    """
    lines = s.withColumnsRenamed({k: f"_{k}" for k in keys})
    kept = top.withColumnsRenamed({c: f"_top_{c}" for c in top.columns if c not in keys})
    same = reduce(Column.__and__, [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys])
    joined = lines.join(F.broadcast(kept), same).groupBy(*kept.columns, *also)
    detailed = joined.agg(*[expression.alias(name) for name, expression in details.items()])
    return detailed.withColumnsRenamed({f"_top_{c}": c for c in top.columns if c not in keys})


LABELS = ("min", "mode")


def names_of(s: DataFrame, keys: list[str], column: str, label: str = "min") -> DataFrame:
    """One ``column`` value for every group of ``keys``: the alphabetically first, or (``mode``) the one on most lines.

    Lines are counted by (keys, value) first, by hashing: a text minimum over lines would make Spark sort them, and a product with a
    third of all lines is counted in all tasks. Values equally frequent go by text; a missing value names nothing.
    """
    if label not in LABELS:
        raise ValueError(f"{label!r} is none of {', '.join(LABELS)}")
    if label == "min":
        return s.select(*keys, column).distinct().groupBy(*keys).agg(F.min(column).alias(column))
    counts = s.groupBy(*keys, F.col(column).alias("Description")).agg(n_lines(s).alias("_n"))
    return _usual(counts, keys).withColumnRenamed("description", column)


def named(
    top: DataFrame, s: DataFrame, keys: list[str], label: str = "min", names: DataFrame | None = None, **details: Column
) -> DataFrame:
    """Add the ``description`` of the few products in ``top``, found by ``keys``, and further details, from the lines.

    With ``names``, a frame of StockCode and Description such as a product table, the lines are not looked at and need hold no
    names: they then need not meet the product table, whose key may be as unevenly spread as products are sold.
    """
    if label not in LABELS:
        raise ValueError(f"{label!r} is none of {', '.join(LABELS)}")
    if names is None and label == "min":
        return details_for(top, s, keys, {"description": F.min("Description"), **details})
    top = details_for(top, s, keys, details) if details else top
    source, by = (s, keys) if names is None else (names, ["StockCode"])
    if label == "min":
        described = details_for(top, source, by, {"description": F.min("Description")})
    else:
        described = _usual(details_for(top, source, [*by], {"_n": n_lines(source)}, also=["Description"]), top.columns)
    if names is None:
        return described
    # a product that the names lack keeps its place; all columns are used, so that Spark shares what leads to the ranking
    known = described.select(F.col("StockCode").alias("_known"))
    unnamed = top.join(F.broadcast(known), F.col("StockCode").eqNullSafe(F.col("_known")), "left_anti")
    return described.unionByName(unnamed.withColumn("description", F.lit(None).cast("string")))


def _usual(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The description on most lines of every group, from (keys, Description, _n); ties by text, null never."""
    return counts.groupBy(*keys).agg(_most().alias("description"))


def _most() -> Column:
    pair = F.struct((-F.col("_n")).alias("n"), F.col("Description").alias("value"))
    return F.min(F.when(F.col("Description").isNotNull(), pair))["value"]


def kept_whole(s: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The same rows, holding all of ``columns`` for each of several readers, which so share the joins' shuffles.

    Spark drops for each reader the columns that only the others need, and would then do the joins below once for each. The
    (always true) condition on a hash of all of them keeps them.
    """
    return s.where(F.xxhash64(*dict.fromkeys(columns)) >= F.lit(-(2**63)))


def measured_and_usual(s: DataFrame, key: str, metrics: Iterable[str], column: str) -> DataFrame:
    """Base measures per ``key``, unrounded, and its ``column`` value on most lines, as of ``names_of``.

    The lines, and what they were joined with, are shuffled once for both: sums and names come from groups by (key, value),
    and the distinct counts are grouped without any amounts.
    """
    base = base_of(metrics)
    counted, summed = [m for m in base if m in DISTINCT], [m for m in base if m in SUMS]
    lines = [LINE_COUNT] if LINE_COUNT in s.columns else []
    s = kept_whole(s, [key, column, *[(DISTINCT | SUMS)[m] for m in (*counted, *summed)], *lines])
    sums = [BASE[m]().alias(m) for m in summed]
    by_value = s.groupBy(key, F.col(column).alias("Description")).agg(*sums, n_lines(s).alias("_n"))
    totals = by_value.groupBy(F.col(key).alias("_key")).agg(_most().alias("_name"), *[F.sum(m).alias(m) for m in summed])
    both = measured(s, [key], counted).join(totals, F.col(key).eqNullSafe(F.col("_key")))
    return both.select(key, F.col("_name").alias(column), *counted, *summed)


def with_name(entities: DataFrame, s: DataFrame, key: str, column: str, name: str, label: str = "min") -> DataFrame:
    """Add a ``column`` value to every entity, see ``names_of``."""
    names = names_of(s, [key], column, label).select(F.col(key).alias("_key"), F.col(column).alias(name))
    return entities.join(names, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
