"""Concentration, order bands, baskets, outliers and sensitivity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.bands import (
    BASKET_SIZE_TOPS,
    ORDER_VALUE_EDGES,
    PRODUCT_PATTERN,
    amount_band,
    count_band,
    is_product,
)
from tillroll.functions.metrics import named, occurring
from tillroll.functions.numbers import percent, rank_key, ratio, rounded, scale_of, unscaled
from tillroll.operators.quality import LINE_KEY
from tillroll.operators.ranks import descending, rows_at_ranks, running_totals

# Items per 64-bit word of a basket's item set.
WORD = 62


def _share(name: str) -> Column:
    return rounded(percent(F.col(name), F.sum(name).over(Window.partitionBy())))


def pareto(s: DataFrame, key: str, noun: str, cuts: Sequence[float], target: float, target_label: str) -> DataFrame:
    """Share of revenue held by the top entities, and how many entities reach the target share.

    Entities of equal revenue are peers: they share one cumulative value, while ranks count them one by one. Equal
    revenues are therefore merged first, which leaves rows without ties for ``running_totals``. Entities without any
    revenue are the last level.
    """
    entities = s.groupBy(key).agg(F.sum("Revenue").alias("revenue"))
    levels = entities.groupBy(descending(rank_key(entities, "revenue")).alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue")
    )
    running = running_totals(levels, "value", ["n", "revenue"]).select(
        "n_all",
        (F.col("n_upto") - F.col("n") + 1).alias("rank"),
        ratio(F.col("revenue_upto"), F.col("revenue_all")).alias("share"),
    )
    reached = F.col("share") >= target
    top = [F.max(F.when(F.col("rank") <= F.col("n_all") * F.lit(p), F.col("share"))) for p in cuts]
    summary = running.agg(
        F.max("n_all").alias("n_all"),
        *[share.alias(f"_{i}") for i, share in enumerate(top)],
        F.min(F.when(reached, F.col("share"))).alias("_share"),
        F.min(F.when(reached, F.col("rank"))).alias("_rank"),
    )

    def row(band: str, entities_in: Column, share: Column) -> Column:
        return F.struct(
            F.lit(band).alias("band"),
            rounded(F.lit(100.0) * share).alias("cumulative_revenue_pct"),
            entities_in.cast("bigint").alias(noun),
        )

    rows = [
        row(f"Top {round(p * 100)}% of {noun}", F.col("n_all") * F.lit(p), F.col(f"_{i}")) for i, p in enumerate(cuts)
    ]
    rows.append(row(target_label, F.col("_rank"), F.col("_share")))
    return summary.select(F.inline(F.array(*rows)))


def product_pareto(s: DataFrame, cuts: Sequence[float] = (0.1, 0.2), target: float = 0.8) -> DataFrame:
    """Over all codes, fees included."""
    label = f"Products needed for {round(target * 100)}% revenue"
    return pareto(s, "StockCode", "products", cuts, target, label)


def customer_pareto(s: DataFrame, cuts: Sequence[float] = (0.01, 0.05, 0.1, 0.2), target: float = 0.8) -> DataFrame:
    label = f"Customers needed for {round(target * 100)}% of revenue"
    rows = pareto(s, "CustomerID", "customers", cuts, target, label)
    return rows.select("band", "customers", "cumulative_revenue_pct")


def order_value_bands(s: DataFrame, edges: Sequence = ORDER_VALUE_EDGES, step=1) -> DataFrame:
    orders = s.groupBy("InvoiceNo").agg(F.sum("Revenue").alias("order_value"))
    bands = orders.groupBy(amount_band(F.col("order_value"), edges, step).alias("order_value_band")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("order_value").alias("revenue")
    )
    return bands.select(
        "order_value_band",
        "orders",
        _share("orders").alias("order_share_pct"),
        rounded(F.col("revenue")).alias("revenue"),
        _share("revenue").alias("revenue_share_pct"),
    ).orderBy("order_value_band")


def basket_size_bands(s: DataFrame, tops: Sequence[int] = BASKET_SIZE_TOPS) -> DataFrame:
    """Orders by their number of distinct products."""
    baskets = s.groupBy("InvoiceNo").agg(F.count_distinct("StockCode").alias("items"))
    bands = baskets.groupBy(count_band(F.col("items"), tops, "item").alias("basket_size")).agg(
        F.count(F.lit(1)).alias("orders"), F.min("items").alias("_first")
    )
    return (
        bands.select("basket_size", "orders", _share("orders").alias("order_share_pct"), "_first")
        .orderBy("_first")
        .drop("_first")
    )


def basket_pairs(
    s: DataFrame, top_items: int = 30, top_pairs: int = 10, pattern: str | None = PRODUCT_PATTERN,
    label: str = "min", names: DataFrame | None = None,
) -> DataFrame:
    """Pairs among the most popular products that occur together in most orders.

    Every order is reduced to the set of popular products it holds, kept as bits, so that an order with any number of
    lines becomes a few bytes before the shuffle. Orders with equal sets are merged, and only then is a set taken
    apart into pairs, at most top_items * (top_items - 1) / 2 of them, which are summed in the same task.
    """
    # popularity, baskets and the number of orders all start from the products that each order holds
    held = occurring(s, ["InvoiceNo", "StockCode"])
    product = F.lit(True) if pattern is None else F.coalesce(is_product(F.col("StockCode"), pattern), F.lit(False))
    popular = (
        held.groupBy("StockCode")
        .agg(F.count("InvoiceNo").alias("orders"))
        .orderBy(product.desc(), F.desc("orders"), "StockCode")
        .limit(top_items)
        .where(product)
    )
    words = [f"_w{i}" for i in range(-(-top_items // WORD))]
    # numbered in the order of the codes: of two items the smaller number has the smaller code
    numbered = popular.withColumn("item", F.row_number().over(Window.partitionBy().orderBy("StockCode")) - 1)

    def bit_in(word: int) -> Column:
        here = F.floor(F.col("item") / WORD) == word
        return F.when(here, F.expr(f"shiftleft(1L, item % {WORD})")).otherwise(F.lit(0).cast("bigint"))

    item_bits = numbered.select(F.col("StockCode").alias("_code"), *[bit_in(i).alias(w) for i, w in enumerate(words)])

    # joined null-safe, and lines without an order left out by the count: a filter would part the shared grouping
    baskets = (
        held.join(F.broadcast(item_bits), F.col("StockCode").eqNullSafe(F.col("_code")))
        .groupBy("InvoiceNo")
        .agg(*[F.bit_or(w).alias(w) for w in words])
        .groupBy(*words)
        .agg(F.count("InvoiceNo").alias("n"))
    )

    def has(i: Column) -> Column:
        return F.getbit(F.get(F.array(*words), F.floor(i / WORD).cast("int")), i % WORD) == 1

    items = F.filter(F.sequence(F.lit(0), F.lit(top_items - 1)), has)
    pairs = F.flatten(
        F.transform(
            F.col("items"),
            lambda a: F.transform(
                F.filter(F.col("items"), lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    counted = (
        baskets.withColumn("items", items)
        .select("n", F.inline(pairs))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("orders_together"))
        .where("orders_together > 0")
    )

    # one row: number -> code and name of each popular product
    described = named(numbered.select("StockCode", "item"), s, ["StockCode"], label, names)
    entries = F.collect_list(F.struct("item", F.struct("StockCode", "description")))
    catalog = described.agg(F.map_from_entries(entries)).scalar()
    all_orders = held.agg(F.count_distinct("InvoiceNo")).scalar()
    return (
        # numbers follow the order of the codes, so ties go by code
        counted.orderBy(F.desc("orders_together"), "a", "b")
        .limit(top_pairs)
        .withColumn("catalog", catalog)
        .select(
            F.col("catalog")[F.col("a")]["StockCode"].alias("item_a"),
            F.col("catalog")[F.col("a")]["description"].alias("description_a"),
            F.col("catalog")[F.col("b")]["StockCode"].alias("item_b"),
            F.col("catalog")[F.col("b")]["description"].alias("description_b"),
            "orders_together",
            rounded(percent(F.col("orders_together"), all_orders)).alias("support_pct"),
        )
    )


def tukey_upper(s: DataFrame, measure: str = "Revenue", mild: str = "1.5", extreme: str = "3.0") -> DataFrame:
    """Quartiles by rank, upper Tukey fences, and what lies beyond them.

    The quartiles are the values at ranks floor(n * p) + 1. Two counting passes find them; a third applies the fences.
    """
    quartiles = {"q1": lambda n: F.floor(n * F.lit(0.25)) + 1, "q3": lambda n: F.floor(n * F.lit(0.75)) + 1}
    scale = scale_of(s, measure)
    ranked = s.select(unscaled(F.col(measure), scale).alias("value")).where(F.col("value").isNotNull())
    money = (F.max("value").cast("decimal(24,0)") / F.lit(10**scale)).cast(f"decimal(22,{scale})")
    found = rows_at_ranks(ranked, ["value"], quartiles).groupBy().pivot("target", ["q1", "q3"]).agg(money)

    q = found.select(F.struct("q1", "q3")).scalar()
    x = F.col(measure)

    def fence(factor: str) -> Column:
        return F.col("q.q3") + F.lit(factor).cast("decimal(4,2)") * (F.col("q.q3") - F.col("q.q1"))

    lines = s.select(measure).withColumn("q", q)
    beyond = lines.withColumns({"_mild": x > fence(mild), "_extreme": x > fence(extreme)}).agg(
        F.count(F.when(F.col("_mild"), True)).alias("mild_outlier_lines"),
        F.count(F.when(F.col("_extreme"), True)).alias("extreme_outlier_lines"),
        rounded(percent(F.sum(F.when(F.col("_extreme"), x)), F.sum(x))).alias("extreme_outlier_revenue_pct"),
    )
    return beyond.withColumn("q", q).select(
        rounded(F.col("q.q1")).alias("q1"),
        rounded(F.col("q.q3")).alias("q3"),
        rounded(fence(mild)).alias("upper_fence"),
        rounded(fence(extreme)).alias("extreme_fence"),
        "mild_outlier_lines",
        "extreme_outlier_lines",
        "extreme_outlier_revenue_pct",
    )


def largest_lines(s: DataFrame, k: int = 10) -> DataFrame:
    """The k lines with the largest revenue, in full."""
    order = ["InvoiceNo", "InvoiceDateTime", "CustomerID", "Country", "StockCode", "Description", "Quantity", "UnitPrice"]
    lines = s.select(*order, rounded(F.col("Revenue")).alias("revenue"))
    top = lines.orderBy(F.desc("revenue"), *order).limit(k)
    return top.withColumn("UnitPrice", F.col("UnitPrice").cast("double"))


def sensitivity_top_order(s: DataFrame, k: int = 1) -> DataFrame:
    """Revenue, orders, AOV and ASP with all orders and without the k largest.

    Both scenarios come from the order totals: what the largest orders hold is taken off the sums. Lines without an order
    number are kept out of the ranking by its order; a filter would be moved below the grouping, and the lines be
    grouped twice.
    """
    orders = s.groupBy("InvoiceNo").agg(F.sum("Revenue").alias("revenue"), F.sum("Quantity").alias("quantity"))
    numbered = F.col("InvoiceNo").isNotNull()
    largest = (
        orders.orderBy(numbered.desc(), F.desc("revenue"), "InvoiceNo")
        .limit(k)
        .where(numbered)
        .agg(
            F.struct(
                F.coalesce(F.sum("revenue"), F.lit(0)).alias("revenue"),
                F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"),
                F.count(F.lit(1)).alias("orders"),
            )
        )
        .scalar()
    )
    totals = orders.agg(
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.count("InvoiceNo").alias("orders"),
        F.sum(F.when(numbered, F.col("revenue"))).alias("revenue_numbered"),
        F.sum(F.when(numbered, F.col("quantity"))).alias("quantity_numbered"),
    ).withColumn("top", largest)

    def scenario(label: str, revenue: Column, orders_in: Column, quantity: Column) -> Column:
        return F.struct(
            F.lit(label).alias("scenario"),
            rounded(revenue).alias("total_revenue"),
            orders_in.alias("orders"),
            rounded(ratio(revenue, orders_in)).alias("aov"),
            rounded(ratio(revenue, quantity)).alias("asp"),
        )

    # Scenario names.
    rows = [
        scenario("As provided", F.col("revenue"), F.col("orders"), F.col("quantity")),
        scenario(
            "Without largest order",
            F.col("revenue_numbered") - F.col("top.revenue"),
            F.col("orders") - F.col("top.orders"),
            F.col("quantity_numbered") - F.col("top.quantity"),
        ),
    ]
    return totals.select(F.inline(F.array(*rows)))


def sensitivity_dedup(s: DataFrame, keys: Sequence[str] = (*LINE_KEY, "Revenue")) -> DataFrame:
    """Lines, revenue and quantity with all lines and with exact duplicates counted once, from one grouping."""
    groups = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("Revenue").alias("_revenue"),
        F.sum("Quantity").alias("_quantity"),
        F.min("Revenue").alias("_one_revenue"),
        F.min("Quantity").alias("_one_quantity"),
    )

    def scenario(label: str, lines: Column, revenue: Column, quantity: Column) -> Column:
        return F.struct(
            F.lit(label).alias("scenario"),
            lines.alias("line_items"),
            rounded(revenue).alias("total_revenue"),
            quantity.alias("quantity"),
        )

    summed = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.sum("_revenue").alias("revenue"),
        F.sum("_quantity").alias("quantity"),
        F.count(F.lit(1)).alias("n_once"),
        F.sum("_one_revenue").alias("revenue_once"),
        F.sum("_one_quantity").alias("quantity_once"),
    )
    rows = [
        scenario("As provided", F.col("n"), F.col("revenue"), F.col("quantity")),
        scenario("Duplicates removed", F.col("n_once"), F.col("revenue_once"), F.col("quantity_once")),
    ]
    return summed.select(F.inline(F.array(*rows)))


def correlation(s: DataFrame, x: str = "UnitPrice", y: str = "Quantity", name: str = "corr_price_quantity") -> DataFrame:
    """Pearson's correlation over the lines; NULL when a column is constant (where ``corr`` would raise)."""
    both = s.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return both.agg(rounded(ratio(F.covar_pop(a, b), spread), 4).alias(name))
