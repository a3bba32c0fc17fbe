"""Ties, gaps, missing values, zero denominators and other corners, on hand-made lines."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sample import dicts, line, sales
from tillroll.functions.bands import ORDER_COUNT_TOPS, PRICE_EDGES, amount_labels, count_labels
from tillroll.functions.numbers import rounded
from tillroll.operators import concentration, customers, kpis, markets, marts, products, quality, trends
from tillroll.plans import grains


def test_band_labels():
    assert amount_labels(PRICE_EDGES, 0.01) == [
        "1 Under 1", "2 1 - 1.99", "3 2 - 4.99", "4 5 - 9.99", "5 10 - 49.99", "6 50 and above",
    ]
    assert amount_labels((100, 250, 5000), 1) == ["1 Under 100", "2 100 - 249", "3 250 - 4,999", "4 5,000 and above"]
    assert count_labels(ORDER_COUNT_TOPS, "order") == ["1 order", "2 orders", "3-5 orders", "6-10 orders", "11+ orders"]


def test_rounding_of_a_third_decimal_five(spark):
    df = spark.createDataFrame([(0.285,), (1.005,), (-0.285,), (2.675,)], "x DOUBLE")
    assert [r.x for r in df.select(rounded(F.col("x")).alias("x")).collect()] == [0.29, 1.01, -0.29, 2.68]


def test_price_bands_at_their_edges(spark):
    s = sales(spark, [line(price=p) for p in ("0.99", "1.00", "1.99", "2.00", "49.99", "50.00")])
    assert {r["price_band"]: r["quantity"] for r in dicts(products.price_bands(s))} == {
        "1 Under 1": 1, "2 1 - 1.99": 2, "3 2 - 4.99": 1, "5 10 - 49.99": 1, "6 50 and above": 1,
    }


def test_large_quantities_do_not_overflow(spark):
    s = sales(spark, [line(quantity=80995), line(quantity=1), line(quantity=3)])
    quantity = dicts(kpis.describe_measures(s))[0]
    assert quantity["metric"] == "Quantity"
    assert (quantity["min_val"], quantity["median_val"], quantity["max_val"]) == (1.0, 3.0, 80995.0)


@pytest.mark.parametrize("values,median", [([5], 5.0), ([1, 2], 1.5), ([3, 1, 2], 2.0), ([4, 1, 1, 9], 2.5)])
def test_median(spark, values, median):
    rows = dicts(kpis.describe_measures(sales(spark, [line(quantity=v) for v in values])))
    assert rows[0]["median_val"] == median


def test_median_of_prices_keeps_its_decimals(spark):
    rows = dicts(kpis.describe_measures(sales(spark, [line(price="0.85"), line(price="1.26")])))
    assert rows[1]["median_val"] == 1.055


def test_missing_month_is_skipped_or_filled(spark):
    s = sales(spark, [line(price="10", ts="2011-01-03"), line(price="20", ts="2011-03-03", invoice="2")])
    assert [r["mom_growth_pct"] for r in dicts(trends.monthly_sales(s))] == [None, 100.0]
    filled = dicts(trends.monthly_sales(s, dense_calendar=True))
    assert [(r["YearMonth"], r["revenue"], r["mom_growth_pct"]) for r in filled] == [
        ("2011-01", 10.0, None), ("2011-02", 0.0, -100.0), ("2011-03", 20.0, None),
    ]
    moving = dicts(trends.running_and_moving(s, dense_calendar=True))
    assert [r["moving_avg_3m"] for r in moving] == [10.0, 5.0, 10.0]
    assert [r["cumulative_revenue"] for r in moving] == [10.0, 10.0, 30.0]


def test_growth_over_a_month_without_revenue(spark):
    s = sales(spark, [line(price="0.00", ts="2011-01-03"), line(price="20", ts="2011-02-03")])
    assert [r["mom_growth_pct"] for r in dicts(trends.monthly_sales(s))] == [None, None]


def test_correlation_of_a_constant(spark):
    s = sales(spark, [line(quantity=q, price="2.00") for q in (1, 2, 3)])
    assert dicts(concentration.correlation(s)) == [{"corr_price_quantity": None}]
    s = sales(spark, [line(quantity=q, price=str(q)) for q in (1, 2, 3)])
    assert dicts(concentration.correlation(s)) == [{"corr_price_quantity": 1.0}]


def test_missing_code_is_no_product(spark):
    s = sales(spark, [line(code=None), line(code="10002A"), line(code="POST"), line(code="1234")])
    split = {r["code_type"]: (r["codes"], r["line_items"]) for r in dicts(products.code_type_split(s))}
    assert split == {"Product": (1, 1), "Non-product (fees/postage/manual)": (2, 3)}
    assert [r["StockCode"] for r in dicts(quality.nonconforming_codes(s))] == ["1234", "POST"]


def test_order_across_noon_counts_in_both_day_parts(spark):
    s = sales(spark, [line(ts="2011-01-03 11:59"), line(ts="2011-01-03 12:00")])
    assert [r["orders"] for r in dicts(trends.day_part_sales(s))] == [1, 1]
    assert dicts(quality.fd_violation_counts(s))[0]["invoices_with_multiple_timestamps"] == 1
    (detail,) = dicts(quality.fd_violation_detail(s))
    assert (detail["timestamps"], detail["first_ts"].hour, detail["last_ts"].hour) == (2, 11, 12)


def test_customer_in_two_countries(spark):
    s = sales(spark, [line(), line(invoice="2", country="Spain"), line(invoice="3", customer=2)])
    found = quality.fd_violations(s, "CustomerID", "Country", "countries", limit=None)
    assert dicts(found) == [{"CustomerID": 1, "countries": 2}]
    assert sum(r["customers"] for r in dicts(markets.country_league(s))) == 3
    rates = {r["Country"]: r["repeat_rate_pct"] for r in dicts(markets.repeat_rate_by(s, min_customers=1))}
    assert rates == {"Spain": 0.0, "United Kingdom": 0.0}


def test_customer_without_number_can_lead_a_ranking(spark):
    s = sales(spark, [line(customer=None, price="9.00"), line(customer=None, price="9.00", invoice="2"), line()])
    top = dicts(customers.top_customers(s))
    assert [(r["CustomerID"], r["orders"], r["revenue"]) for r in top] == [(None, 2, 18.0), (1, 1, 1.0)]


def test_young_cohorts(spark):
    s = sales(
        spark,
        [line(ts="2011-01-03"), line(ts="2011-02-03", invoice="2"), line(ts="2011-02-04", invoice="3", customer=2)],
    )
    plain = dicts(customers.cohort_retention(s))
    assert [(r["cohort"], r["cohort_size"], r["m1_pct"], r["m2_pct"]) for r in plain] == [
        ("2011-01", 1, 100.0, 0.0), ("2011-02", 1, 0.0, 0.0),
    ]
    censored = dicts(customers.cohort_retention(s, censor=True))
    assert [(r["m1_pct"], r["m2_pct"]) for r in censored] == [(100.0, None), (None, None)]


def test_recency_against_a_given_day(spark):
    s = sales(spark, [line(ts="2011-01-03"), line(customer=2, invoice="2", ts="2011-01-10")])
    assert {r["CustomerID"]: r["recency_days"] for r in dicts(customers.rfm(s))} == {1: 8, 2: 1}
    later = customers.rfm(s, snapshot=F.lit("2011-01-12").cast("date"))
    assert {r["CustomerID"]: r["recency_days"] for r in dicts(later)} == {1: 10, 2: 3}


def test_pareto_counts_peers_together(spark):
    # four customers of equal revenue: each holds the cumulative share of all four
    s = sales(spark, [line(customer=c, invoice=str(c), price="5.00") for c in (1, 2, 3, 4)])
    rows = {r["band"]: (r["customers"], r["cumulative_revenue_pct"]) for r in dicts(concentration.customer_pareto(s))}
    assert rows["Top 20% of customers"] == (0, None)
    assert rows["Customers needed for 80% of revenue"] == (1, 100.0)


def test_quartiles_by_rank(spark):
    s = sales(spark, [line(price=f"{p}.00") for p in (1, 2, 3, 4, 5, 6, 7, 100)])
    (row,) = dicts(concentration.tukey_upper(s))
    # n * p is whole: the value after it counts
    assert (row["q1"], row["q3"], row["upper_fence"], row["extreme_fence"]) == (3.0, 7.0, 13.0, 19.0)
    assert (row["mild_outlier_lines"], row["extreme_outlier_lines"], row["extreme_outlier_revenue_pct"]) == (1, 1, 78.13)


def test_pairs_in_orders_with_repeated_items(spark):
    items = {"1": "ABC", "2": "AB", "3": "BA", "4": "C", "5": "AAAA"}
    code = {"A": "10001", "B": "10002", "C": "10003"}
    s = sales(spark, [line(invoice=i, code=code[c], description=c) for i, cs in items.items() for c in cs])
    shown = ("description_a", "description_b", "orders_together", "support_pct")
    assert [tuple(r[c] for c in shown) for r in dicts(concentration.basket_pairs(s))] == [("A", "B", 3, 60.0), ("A", "C", 1, 20.0), ("B", "C", 1, 20.0)]


def test_pairs_among_more_items_than_a_word_holds(spark):
    lines = [line(invoice=str(i), code=str(10000 + c), description=str(c)) for i in (1, 2) for c in range(70)]
    lines += [line(invoice="3", code="10000"), line(invoice="3", code="10069")]
    pairs = dicts(concentration.basket_pairs(sales(spark, lines), top_items=70, top_pairs=3000))
    assert len(pairs) == 70 * 69 // 2
    first = [(p["item_a"], p["item_b"], p["orders_together"]) for p in pairs[:2]]
    assert first == [("10000", "10069", 3), ("10000", "10001", 2)]


def test_orders_without_number_are_no_orders(spark):
    s = sales(spark, [line(invoice=None, price="100.00"), line(price="5.00"), line(invoice="2", price="1.00")])
    with_all, without = dicts(concentration.sensitivity_top_order(s))
    assert (with_all["total_revenue"], with_all["orders"]) == (106.0, 2)
    assert (without["total_revenue"], without["orders"], without["aov"]) == (1.0, 1, 1.0)
    (month,) = dicts(trends.monthly_excluding_top_orders(s))
    assert (month["revenue_as_provided"], month["revenue_excl_largest_order"]) == (106.0, 1.0)


def test_duplicates_with_missing_values(spark):
    s = sales(spark, [line(description=None)] * 3 + [line(), line(quantity=2)])
    (row,) = dicts(quality.duplicate_summary(s))
    assert (row["duplicate_groups"], row["surplus_rows"], row["pct_of_rows"]) == (1, 2, 40.0)
    assert row["revenue_in_surplus_rows"] == 2.0
    assert [r["line_items"] for r in dicts(concentration.sensitivity_dedup(s))] == [5, 3]


def test_extremes_of_nothing(spark):
    rows = dicts(quality.flag_extremes(sales(spark, [])))
    assert [(r["rows_flagged"], r["revenue"]) for r in rows] == [(0, None)] * 4


def test_price_mean_is_over_lines(spark):
    s = sales(spark, [line(price="30.00", quantity=1), line(price="20.00", quantity=100), line(code="10002", price="19.99")])
    (row,) = dicts(products.premium_products(s))
    assert (row["StockCode"], row["avg_unit_price"], row["quantity"]) == ("10001", 25.0, 101)


def test_ties_at_a_cut_go_by_code(spark):
    s = sales(spark, [line(code=str(10020 - i), quantity=10) for i in range(15)])
    assert [r["StockCode"] for r in dicts(products.bottom_products(s))] == [str(10006 + i) for i in range(10)]


def test_approximate_counts_have_the_same_columns(spark):
    s = sales(spark, [line()])
    assert dicts(quality.cardinality(s, approx=True)) == dicts(quality.cardinality(s))
    assert dicts(kpis.headline_kpis(s, approx=True)) == dicts(kpis.headline_kpis(s))


def test_money_sums_are_exact(spark):
    s = sales(spark, [line(price="0.10")] * 10)
    assert kpis.per_order(s).first().order_value == Decimal("1.0000")


def test_entities_without_revenue_are_last(spark):
    amounts = {"A": 70, "B": 20, "C": 10, "D": None, "E": None}
    rows = [line(invoice=c, code=c, price=None if v is None else str(v)) for c, v in amounts.items()]
    out = dicts(concentration.product_pareto(sales(spark, rows), cuts=(0.4,)))
    assert [(r["products"], r["cumulative_revenue_pct"]) for r in out] == [(2, 90.0), (2, 90.0)]


def test_customers_without_revenue_are_in_the_last_quartile(spark):
    amounts = [None, 40, None, 30, 20, 10, 5, 1]
    rows = [line(invoice=str(i), customer=i, price=None if v is None else str(v)) for i, v in enumerate(amounts)]
    out = dicts(customers.value_quantiles(sales(spark, rows)))
    assert [(r["max_revenue"], r["customers"]) for r in out] == [(40.0, 2), (20.0, 2), (5.0, 2), (None, 2)]


def test_quantiles_have_labels_for_any_number(spark):
    rows = sales(spark, [line(invoice=str(i), customer=i, price=str(i)) for i in range(1, 13)])
    names = [r["value_segment"] for r in dicts(customers.value_quantiles(rows, 6))]
    assert names == [f"Q{i} of 6" for i in range(1, 7)]
    with pytest.raises(ValueError):
        customers.value_quantiles(rows, 3, ["high", "low"])


@pytest.mark.parametrize("n", [4, 5, 10])
def test_segments_for_other_numbers_of_scores(spark, n):
    lines = [
        line(invoice=f"{c}-{i}", customer=c, price=str(c), ts=f"2011-{1 + c % 12:02d}-{1 + i:02d} 10:00")
        for c in range(1, 41)
        for i in range(1 + c % 5)
    ]
    rows = sales(spark, lines)
    rows.createOrReplaceTempView("lines_of_rfm")
    expected = spark.sql(f"""
        WITH c AS (SELECT CustomerID, max(InvoiceDay) AS last, count(DISTINCT InvoiceNo) AS f, sum(Revenue) AS m
                   FROM lines_of_rfm GROUP BY 1),
        s AS (SELECT CustomerID, {n} + 1 - ntile({n}) OVER (ORDER BY last DESC, CustomerID) AS r,
                     ntile({n}) OVER (ORDER BY f, m, CustomerID) AS f FROM c)
        SELECT CustomerID, CASE WHEN r >= 4 AND f >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 THEN 'Loyal Customers'
            WHEN r >= 4 AND f <= 2 THEN 'New / Promising' WHEN r = 3 AND f <= 2 THEN 'Need Attention'
            WHEN r <= 2 AND f >= 4 THEN 'Cannot Lose Them' WHEN r <= 2 AND f >= 2 THEN 'At Risk'
            ELSE 'Lost / Hibernating' END AS segment FROM s""")
    got = customers.rfm(rows, n=n).select("CustomerID", "segment")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_rules_that_no_score_meets_are_refused(spark):
    with pytest.raises(ValueError, match="Champions"):
        customers.rfm(sales(spark, [line()]), n=3)
    own = [("Best", 3, None, 3, None)]
    assert customers.rfm(sales(spark, [line()]), n=3, rules=own, rest="Other").columns[-1] == "segment"


def test_totals_beyond_bigint_keep_their_rank(spark):
    big = "9" * 14 + ".9999"
    lines = [line(invoice=str(i), code=f"1000{i % 3 // 2}", customer=i % 3 // 2, revenue=big) for i in range(30)]
    rows = sales(spark, [*lines, line(invoice="x", code="2", customer=7, price="1")])
    assert [r["products"] for r in dicts(concentration.product_pareto(rows, cuts=(0.4,)))] == [1, 2]
    assert dicts(concentration.customer_pareto(rows, cuts=(0.4,)))[-1]["customers"] == 2
    assert [r["customers"] for r in dicts(customers.value_quantiles(rows, 3))] == [1, 1, 1]
    orders = sales(spark, [line(invoice="1", code=str(i), revenue=big) for i in range(20)])
    assert dicts(kpis.describe_orders(orders))[0]["max_val"] == pytest.approx(2e15)


def test_usual_names_go_by_lines_then_by_text(spark):
    lines = [line(code="10001", description=d) for d in ["white", "white", "cream", "azure", "azure", None, None, None]]
    lines += [line(code="10002", description=None), line(code="10003", description="b"), line(code="10003", description="a")]
    s = sales(spark, lines)
    for frame in (s, grains.item_grain(s)):  # a summed row counts as the lines it stands for
        got = {r["StockCode"]: r["description"] for r in products.top_products_by_quantity(frame, label="mode").collect()}
        assert got == {"10001": "azure", "10002": None, "10003": "a"}
        mart = {r["StockCode"]: r["Description"] for r in marts.mart_product(frame, label="mode").collect()}
        assert mart == got
    with pytest.raises(ValueError):
        products.top_products_by_quantity(s, label="longest")


@pytest.mark.parametrize("label", ["min", "mode"])
def test_product_mart_counts_nulls_and_copies_as_its_parts_do(spark, label):
    lines = [
        line(invoice=i, code=c, customer=k, description=d, quantity=q, price=p)
        for c in ("10001", "10002", None)
        for i, k, d, q, p in [
            ("1", 1, "b", 2, "1.10"), ("1", 1, "b", 2, "1.10"), ("1", 2, "a", 3, "2"), ("2", None, None, 1, "5"),
            (None, 3, "b", 4, "0.25"), (None, None, "A", 1, None), ("3", 1, "A", None, "3"),
        ][: 6 if c else 7]
    ] + [line(code="10003", invoice=None, customer=None, description=None, quantity=None)]
    s = sales(spark, lines)
    for frame in (s, grains.item_grain(s)):
        got = {r["StockCode"]: tuple(r)[1:] for r in marts.mart_product(frame, label=label).collect()}
        name = "A" if label == "min" else "b"
        assert got == {
            "10001": (name, 2, 3, 13, 16.4, 1.26),
            "10002": (name, 2, 3, 13, 16.4, 1.26),
            None: ("A", 3, 3, 13, 16.4, 1.26) if label == "min" else ("b", 3, 3, 13, 16.4, 1.26),
            "10003": (None, 0, 0, None, None, None),
        }


def test_names_from_a_table_keep_products_without_one(spark):
    s = sales(spark, [line(code="10001", quantity=5), line(code="10002", quantity=3), line(code="10003")]).drop("Description")
    names = spark.createDataFrame([("10001", "tea"), ("10003", "cup"), ("10003", "Cup")], "StockCode string, Description string")
    for label, cup in (("min", "Cup"), ("mode", "Cup")):
        for top in (products.top_products_by_quantity, products.top_products_by_revenue, products.top_products_by_orders):
            got = {r["StockCode"]: r["description"] for r in top(s, label=label, names=names).collect()}
            assert got == {"10001": "tea", "10002": None, "10003": cup}
