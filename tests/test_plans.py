"""What the plans must look like when no table is small enough to be broadcast, and how often they read the lines."""

import re

import pytest

import __spark_entry__ as registry
from sample import line, sales
from tillroll.plans.catalogue import REPORTS
from tillroll.sources.files import read_sales, write_sales

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture
def large_tables(spark):
    """As if every table were large: plans are looked at before they run."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def plan(df) -> list[str]:
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for x in lines if re.search("[A-Za-z]", x)]


@pytest.mark.parametrize(
    "name",
    [
        "q3_01_headline_kpis",
        "q5_01_top_customers_by_revenue",
        "q5_02_top_customers_by_orders",
        "q7_01_country_league",
        "q7_02_home_vs_rest",
        "q7_03_repeat_rate_by_country",
        "q9_02_mart_customer",
        "q9_04_mart_country",
    ],
)
def test_lines_are_not_shuffled_by_customer_before_they_are_summed(spark, large_tables, name):
    lines = plan(QUERIES[name](spark, SF_DIR))
    for i, text in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\((c_custkey|CustomerID|o_custkey)#\d+L?, \d+\)", text):
            depth = re.search(r"[A-Za-z*]", text).start()
            below = []
            for other in lines[i + 1 :]:
                if re.search(r"[A-Za-z*]", other).start() <= depth:
                    break
                below.append(other)
            whole = "\n".join(below)
            # customers, orders, or what lines have been summed to
            assert "l_extendedprice" not in whole or "HashAggregate" in below[0] or "partial_" in below[0], text


@pytest.mark.parametrize(
    "name",
    [
        "q2_07_nonconforming_codes",
        "q6_01_top_products_by_revenue",
        "q6_02_top_products_by_quantity",
        "q6_03_top_products_by_orders",
        "q6_04_bottom_products",
        "q6_07_top_products_by_countries",
        "q6_09_premium_products",
        "q7_04_top_products_per_country",
        "q8_04_basket_pairs",
        "q9_03_mart_product",
    ],
)
def test_lines_are_not_shuffled_by_product_before_they_are_summed(spark, large_tables, name):
    """What is dealt by product has been summed, or cut to distinct values, within each task before."""
    lines = plan(QUERIES[name](spark, SF_DIR))
    assert not any(re.search(r"Exchange hashpartitioning\(l_partkey#\d+L?, \d+\)", text) for text in lines)
    for i, text in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\(_?StockCode#\d+, \d+\)", text) and "ReusedExchange" not in text:
            assert i + 1 == len(lines) or re.search("Aggregate|WindowGroupLimit|TakeOrdered", lines[i + 1]), text


def test_usual_names_shuffle_the_lines_once_and_as_numbers(spark, large_tables):
    """Measures and names are grouped from the same lines, met once with orders and parts."""
    lines = plan(QUERIES["q9_03_usual_names"](spark, SF_DIR))
    assert [sum(f"/{table}.parquet" in text for text in lines) for table in ("lineitem", "orders", "part")] == [1, 1, 1]
    for i, text in enumerate(lines):
        if re.search(r"- Exchange hashpartitioning\(l_(orderkey|partkey)#", text):
            assert "concat" not in lines[i + 1] and "as string" not in lines[i + 1], lines[i + 1]


def test_grain_control_shuffles_the_lines_once_for_all_that_it_compares(spark, large_tables):
    """Lines, sums per order and sums per product are grouped where the lines lie, and only distinct values move after that."""
    lines = plan(QUERIES["s7_grain_control"](spark, SF_DIR))
    assert [sum(f"/{table}.parquet" in text for text in lines) for table in ("lineitem", "orders", "part")] == [1, 1, 1]
    for i, text in enumerate(lines):
        if re.search(r"- Exchange hashpartitioning\((l_partkey#|cast\()", text):
            assert "concat" not in lines[i + 1] and "InvoiceNo" not in lines[i + 1], lines[i + 1]
        elif "- Exchange hashpartitioning(" in text and "HashAggregate" in lines[i + 1]:
            assert "gid#" in text, text


def scans(df) -> int:
    return sum("FileScan parquet" in text for text in plan(df))


def test_reports_do_not_read_the_lines_more_often_than_needed(spark, tmp_path):
    rows = sales(spark, [line(invoice=str(i), customer=i, code=f"1000{i % 4}") for i in range(8)])
    write_sales(rows, str(tmp_path / "s"))
    stored = read_sales(spark, str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = {tag: scans(report(stored)) for tag, report in REPORTS.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert counts["Q4.10"] == 1 and counts["Q8.7"] == 1
    assert counts["Q5.1"] <= 2 and counts["Q6.1"] <= 2
    assert counts["Q6.3"] == counts["Q7.4"] == counts["Q8.4"] == 2
    assert sum(counts.values()) <= 83
