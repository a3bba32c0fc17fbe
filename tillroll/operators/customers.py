"""Who buys, how often and how much: rankings, bands, quantiles, RFM, cohorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.bands import ORDER_COUNT_TOPS, count_band, customer_type
from tillroll.functions.calendar import month_label, month_number
from tillroll.functions.metrics import BASE, details_for, sales_by
from tillroll.functions.numbers import count_true, percent, rank_key, ratio, rounded, unscaled
from tillroll.operators.kpis import per_customer
from tillroll.operators.ranks import descending, with_ntiles

# Names of revenue quartiles and RFM segments.
QUARTILE_LABELS = (
    "Q1 - Top 25% (High value)",
    "Q2 - Upper-mid 25%",
    "Q3 - Lower-mid 25%",
    "Q4 - Bottom 25% (Low value)",
)
# segment, least and greatest recency score, least and greatest frequency score (None: open); the first that fits counts
RFM_SEGMENTS = (
    ("Champions", 4, None, 4, None),
    ("Loyal Customers", 3, None, 3, None),
    ("New / Promising", 4, None, None, 2),
    ("Need Attention", 3, 3, None, 2),
    ("Cannot Lose Them", None, 2, 4, None),
    ("At Risk", None, 2, 2, None),
)
RFM_REST = "Lost / Hibernating"

# months per 64-bit word of a customer's activity, and the months there is room for
WORD = 62
SINCE, UNTIL = "1990-01", "2030-12"


def _share_of_all(name: str) -> Column:
    """A grouped amount as percentage of its sum over the (few) groups."""
    return rounded(percent(F.col(name), F.sum(name).over(Window.partitionBy())))


def top_customers(s: DataFrame, by: str = "revenue", k: int = 10) -> DataFrame:
    """The k customers with the largest ``by`` ('revenue' or 'orders'), ties by revenue, then by customer."""
    return _top_by_revenue(s, k) if by == "revenue" else _top_by_orders(s, k)


def _top_by_revenue(s: DataFrame, k: int) -> DataFrame:
    totals = s.groupBy("CustomerID").agg(F.sum("Quantity").alias("quantity"), F.sum("Revenue").alias("sold"))
    order = [F.desc("revenue"), F.col("CustomerID")]
    top = totals.withColumn("revenue", rounded(F.col("sold"))).orderBy(order).limit(k)
    # from the grouped customers, by all their columns, so that Spark reuses the shuffle of the ranking
    total = totals.agg(F.struct(F.sum("sold").alias("sold"), F.sum("quantity").alias("quantity"))).scalar()
    share = rounded(percent(F.col("sold"), total["sold"])).alias("revenue_share_pct")
    detailed = details_for(top, s, ["CustomerID"], {"country": F.min("Country"), "orders": BASE["orders"]()})
    return detailed.orderBy(order).select("CustomerID", "country", "orders", "quantity", "revenue", share)


def _top_by_orders(s: DataFrame, k: int) -> DataFrame:
    metrics = ["orders", "revenue", "aov"]
    ranked = sales_by(s, ["CustomerID"], metrics)
    order = [F.desc("orders"), F.desc("revenue"), F.col("CustomerID")]
    top = details_for(ranked.orderBy(order).limit(k), s, ["CustomerID"], {"country": F.min("Country")})
    return top.orderBy(order).select("CustomerID", "country", *metrics)


def order_frequency_bands(s: DataFrame, tops: Sequence[int] = ORDER_COUNT_TOPS) -> DataFrame:
    """Customers by their number of orders."""
    bands = (
        per_customer(s)
        .groupBy(count_band(F.col("orders"), tops, "order").alias("order_frequency_band"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("revenue"), F.min("orders").alias("_first"))
    )
    return (
        bands.select(
            "order_frequency_band",
            "customers",
            _share_of_all("customers").alias("customer_share_pct"),
            rounded(F.col("revenue")).alias("revenue"),
            _share_of_all("revenue").alias("revenue_share_pct"),
            "_first",
        )
        .orderBy("_first")
        .drop("_first")
    )


def value_quantiles(s: DataFrame, n: int = 4, labels: Sequence[str] | None = None) -> DataFrame:
    """Customers split into n groups of equal size by revenue, largest first; ties go by customer.

    Customers without any revenue come last. ``labels`` name the n groups, by default "Q1" to "Qn" (quartiles: in full).
    """
    if labels is None:
        labels = QUARTILE_LABELS if n == len(QUARTILE_LABELS) else [f"Q{i} of {n}" for i in range(1, n + 1)]
    if len(labels) != n:
        raise ValueError(f"{len(labels)} labels for {n} groups")
    customers = s.groupBy("CustomerID").agg(F.sum("Revenue").alias("revenue"))
    order = [descending(rank_key(customers, "revenue")), F.col("CustomerID")]
    tiles = (
        with_ntiles(customers, n, {"tile": order})
        .groupBy("tile")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.min("revenue").alias("lowest"),
            F.max("revenue").alias("highest"),
            F.sum("revenue").alias("revenue"),
        )
    )
    return (
        tiles.select(
            F.get(F.array(*[F.lit(x) for x in labels]), F.col("tile") - 1).alias("value_segment"),
            "customers",
            rounded(F.col("lowest")).alias("min_revenue"),
            rounded(F.col("highest")).alias("max_revenue"),
            rounded(ratio(F.col("revenue"), F.col("customers"))).alias("avg_revenue"),
            rounded(F.col("revenue")).alias("revenue"),
            _share_of_all("revenue").alias("revenue_share_pct"),
            "tile",
        )
        .orderBy("tile")
        .drop("tile")
    )


def repeat_vs_onetime(s: DataFrame) -> DataFrame:
    kinds = (
        per_customer(s)
        .groupBy(customer_type(F.col("orders")).alias("customer_type"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    )
    return kinds.select(
        "customer_type",
        "customers",
        rounded(F.col("revenue")).alias("revenue"),
        rounded(ratio(F.col("revenue"), F.col("customers"))).alias("avg_revenue_per_customer"),
        rounded(ratio(F.col("orders"), F.col("customers"))).alias("avg_orders"),
        rounded(ratio(F.col("revenue"), F.col("orders"))).alias("aov"),
    ).orderBy("customer_type")


def active_months(s: DataFrame, since: str = SINCE, until: str = UNTIL) -> DataFrame:
    """(CustomerID, months): the months with sales of every customer, as sorted numbers (``month_number``).

    A month is a bit of one of a few 64-bit words, or-ed together in every task: one row per customer and task is shuffled,
    however many lines or months the customer has. A month before ``since`` or after ``until`` raises an error.
    """
    first, last = (12 * int(x[:4]) + int(x[5:]) for x in (since, until))
    n_words = -(-(last - first + 1) // WORD)
    known = s.where(F.col("CustomerID").isNotNull() & F.col("YearMonth").isNotNull())
    at = month_number(F.col("YearMonth")) - first
    beyond = F.raise_error(F.concat(F.lit(f"not from {since} to {until}: "), F.col("YearMonth"))).cast("int")
    placed = known.select("CustomerID", F.when(at.between(0, last - first), at).otherwise(beyond).alias("_at"))
    here, bit = F.floor(F.col("_at") / WORD), F.expr(f"shiftleft(1L, _at % {WORD})")
    words = placed.groupBy("CustomerID").agg(
        *[F.bit_or(F.when(here == i, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_w{i}") for i in range(n_words)]
    )

    def months_of(i: int) -> Column:
        word = F.col(f"_w{i}")
        start = first + WORD * i
        bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit(word, b) == 1)
        return F.when(word != 0, F.transform(bits, lambda b: b + start)).otherwise(F.array().cast("array<int>"))

    return words.select("CustomerID", F.concat(*[months_of(i) for i in range(n_words)]).alias("months"))


def new_vs_returning(s: DataFrame) -> DataFrame:
    """Active customers of every month: bought for the first time, or before."""
    active = active_months(s).select(F.col("months")[0].alias("first"), F.explode("months").alias("month"))
    returning = count_true(F.col("month") > F.col("first"))
    return (
        active.groupBy(month_label(F.col("month")).alias("YearMonth"))
        .agg(
            count_true(F.col("month") == F.col("first")).alias("new_customers"),
            returning.alias("returning_customers"),
            F.count(F.lit(1)).alias("active_customers"),
            rounded(percent(returning, F.count(F.lit(1)))).alias("returning_pct"),
        )
        .orderBy("YearMonth")
    )


def purchase_gaps(s: DataFrame) -> DataFrame:
    """How many months lie between a customer's active months: gaps of each length, and customers who have one."""
    gaps = F.transform(F.col("months"), lambda m, i: m - F.get(F.col("months"), i - 1))
    lengths = active_months(s).select(F.slice(gaps, 2, F.size("months")).alias("gaps"))
    each = lengths.select(F.explode(F.array_distinct("gaps")).alias("gap_months"), "gaps")
    times = F.size(F.filter("gaps", lambda g: g == F.col("gap_months")))
    return (
        each.groupBy("gap_months")
        .agg(F.sum(times).alias("gaps"), F.count(F.lit(1)).alias("customers"))
        .orderBy("gap_months")
    )


def purchase_span(s: DataFrame) -> DataFrame:
    """Days between first and last purchase of customers with several orders, and the mean gap between orders."""
    spans = (
        s.groupBy("CustomerID")
        .agg(
            F.date_diff(F.max("InvoiceDay"), F.min("InvoiceDay")).alias("days"),
            F.count_distinct("InvoiceNo").alias("orders"),
        )
        .where(F.col("orders") > 1)
    )
    # gaps enter as fixed-point numbers: their sum does not depend on the order of rows
    gap = ratio(F.col("days"), F.col("orders") - 1).cast("decimal(18,9)")
    return spans.agg(
        F.count(F.lit(1)).alias("repeat_customers"),
        rounded(ratio(F.sum("days"), F.count("days")), 1).alias("avg_days_between_first_last"),
        rounded(ratio(F.sum(gap), F.count("days")), 1).alias("avg_days_between_orders"),
        F.max("days").cast("double").alias("max_days_active"),
    )


def rfm(
    s: DataFrame, snapshot: Column | None = None, n: int = 5, rules: Sequence[tuple] = RFM_SEGMENTS, rest: str = RFM_REST
) -> DataFrame:
    """Recency, frequency and monetary value of every customer, their scores from 1 to n, and the segment.

    ``snapshot`` is the last day looked at, by default the last day with sales; recency counts from the day after it.
    Ties in a score are broken by customer. The customers are never sorted as a whole: see ``with_ntiles``.
    ``rules`` name the segments by score (see ``RFM_SEGMENTS``); a rule that no score up to n can meet is refused.
    """
    unmet = [name for name, *bounds in rules if max(b or 0 for b in bounds) > n]
    if unmet:
        raise ValueError(f"no score from 1 to {n} meets the rules of {', '.join(unmet)}")
    customers = s.groupBy("CustomerID").agg(
        F.max("InvoiceDay").alias("_last"),
        F.count_distinct("InvoiceNo").alias("frequency"),
        F.round(F.sum("Revenue"), 2).alias("monetary"),
    )
    if snapshot is None:
        # from the grouped customers, by all their columns, so that Spark reuses their shuffle
        parts = [F.max(c).alias(c) for c in ("_last", "frequency", "monetary")]
        snapshot = customers.agg(F.struct(*parts)).scalar()["_last"]
    last_day = snapshot
    base = customers.select(
        "CustomerID", (F.date_diff(last_day, F.col("_last")) + 1).alias("recency_days"), "frequency", "monetary"
    )
    customer, money = F.col("CustomerID"), unscaled(F.col("monetary"), 2)
    scored = with_ntiles(
        base,
        n,
        {
            "_r": [F.col("recency_days"), customer],
            "f_score": [F.col("frequency"), money, customer],
            "m_score": [money, customer],
        },
    ).withColumn("r_score", F.lit(n + 1) - F.col("_r"))
    return scored.select(
        "CustomerID",
        "recency_days",
        "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        "r_score",
        "f_score",
        "m_score",
        rfm_segment(rules, rest),
    )


def rfm_segment(rules: Sequence[tuple] = RFM_SEGMENTS, rest: str = RFM_REST) -> Column:
    segment = F.lit(rest)
    for name, r_low, r_high, f_low, f_high in reversed(rules):
        fits = F.lit(True)
        for score, low, high in (("r_score", r_low, r_high), ("f_score", f_low, f_high)):
            fits &= F.lit(True) if low is None else F.col(score) >= low
            fits &= F.lit(True) if high is None else F.col(score) <= high
        segment = F.when(fits, name).otherwise(segment)
    return segment.alias("segment")


def rfm_summary(scored: DataFrame) -> DataFrame:
    """Size and value of every RFM segment, from the result of ``rfm``."""
    money = F.col("monetary").cast("decimal(18,2)")
    segments = scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("recency_days").alias("recency"),
        F.sum("frequency").alias("orders"),
        F.sum(money).alias("revenue"),
    )
    return segments.select(
        "segment",
        "customers",
        _share_of_all("customers").alias("customer_share_pct"),
        rounded(ratio(F.col("recency"), F.col("customers")), 1).alias("avg_recency_days"),
        rounded(ratio(F.col("orders"), F.col("customers"))).alias("avg_orders"),
        rounded(ratio(F.col("revenue"), F.col("customers"))).alias("avg_revenue"),
        rounded(F.col("revenue")).alias("revenue"),
        _share_of_all("revenue").alias("revenue_share_pct"),
    ).orderBy(F.desc("revenue"), "segment")


def cohort_retention(s: DataFrame, offsets: Sequence[int] = (1, 2, 3, 6, 12), censor: bool = False) -> DataFrame:
    """Share of each first-purchase month's customers who buy again m months later.

    Months after the end of the data count as 0, or as NULL with ``censor``.
    """
    months, first = F.col("months"), F.col("months")[0]
    counted = (
        active_months(s)
        .groupBy(month_label(first).alias("cohort"))
        .agg(
            *[count_true(F.array_contains(months, first + m)).alias(f"_m{m}") for m in (0, *offsets)],
            F.max(F.element_at(months, -1) - first).alias("_seen"),
        )
    )
    end = F.max(month_number(F.col("cohort")) + F.col("_seen")).over(Window.partitionBy())

    def share(m: int) -> Column:
        value = rounded(percent(F.col(f"_m{m}"), F.col("_m0")), 1)
        if censor:
            value = F.when(month_number(F.col("cohort")) + m <= end, value)
        return value.alias(f"m{m}_pct")

    return counted.select("cohort", F.col("_m0").alias("cohort_size"), *[share(m) for m in offsets]).orderBy("cohort")
