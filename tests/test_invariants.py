"""What must add up across reports, and what must not, on the test tables."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators import concentration, customers, kpis, markets, products, quality, trends
from tillroll.sources import star

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    lines = star.sales_lines(spark, SF_DIR, countries=True, parts=True).cache()
    yield lines
    lines.unpersist()


@pytest.fixture(scope="module")
def head(s):
    return kpis.headline_kpis(s).first()


def column_sum(df, name):
    return sum(r[name] for r in df.collect())


REVENUE = {
    "year": kpis.yearly_sales,
    "quarter": trends.quarterly_sales,
    "month": trends.monthly_sales,
    "calendar month": trends.seasonality,
    "weekday": trends.weekday_sales,
    "hour": trends.hourly_sales,
    "day part": trends.day_part_sales,
    "frequency band": customers.order_frequency_bands,
    "quartile": customers.value_quantiles,
    "customer type": customers.repeat_vs_onetime,
    "segment": lambda s: customers.rfm_summary(customers.rfm(s)),
    "price band": products.price_bands,
    "code type": products.code_type_split,
    "country": markets.country_league,
    "order value band": concentration.order_value_bands,
}


@pytest.mark.parametrize("split", list(REVENUE))
def test_revenue_adds_up(s, head, split):
    # each row is rounded to a cent
    assert column_sum(REVENUE[split](s), "revenue") == pytest.approx(head.total_revenue, abs=0.01 * 100)


def test_customers_add_up(s, head):
    assert column_sum(customers.order_frequency_bands(s), "customers") == head.total_customers
    assert column_sum(customers.value_quantiles(s), "customers") == head.total_customers
    assert column_sum(customers.rfm_summary(customers.rfm(s)), "customers") == head.total_customers
    assert column_sum(customers.cohort_retention(s), "cohort_size") == head.total_customers
    assert column_sum(customers.new_vs_returning(s), "new_customers") == head.total_customers


def test_orders_and_rows_add_up(s, head):
    assert column_sum(concentration.order_value_bands(s), "orders") == head.total_orders
    assert column_sum(concentration.basket_size_bands(s), "orders") == head.total_orders
    assert column_sum(quality.period_coverage(s), "rows_in_month") == head.line_items
    assert column_sum(quality.day_of_month_coverage(s), "rows_on_that_day") == head.line_items


def test_running_total_ends_at_total(s, head):
    assert trends.running_and_moving(s).collect()[-1].cumulative_revenue == head.total_revenue


def test_largest_order_is_left_out_once(s):
    months = trends.monthly_excluding_top_orders(s)
    without = concentration.sensitivity_top_order(s).collect()[1].total_revenue
    assert column_sum(months, "revenue_excl_largest_order") == pytest.approx(without, abs=0.5)


def test_duplicates_agree(s):
    keys = ["l_orderkey", "l_linenumber"]
    surplus = quality.duplicate_summary(s, keys).first().surplus_rows
    every, once = concentration.sensitivity_dedup(s, keys).collect()
    assert surplus > 0
    assert every.line_items - once.line_items == surplus


def test_distinct_counts_do_not_add_up_over_bands(s, head):
    banded = products.price_bands(s, (500, 1000, 2500, 5000, 10000), 1)
    assert column_sum(banded, "products") > head.total_products


def plan_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_only_needed_columns_are_read(spark):
    plan = plan_of(trends.running_and_moving(star.sales_lines(spark, SF_DIR)))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


BROADCASTING = (
    "q5_08_rfm",
    "q6_01_top_products_by_revenue",
    "q6_08_product_pareto",
    "q8_04_basket_pairs",
    "q8_05_tukey_upper",
    "q3_04_describe_measures",
)


@pytest.mark.parametrize("name", BROADCASTING)
def test_no_cartesian_joins(spark, name):
    import __spark_entry__ as registry

    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_filter_runs_before_the_shuffle(spark):
    lines = star.sales_lines(spark, SF_DIR, countries=True, parts=True)
    plan = plan_of(markets.top_products_per_country(lines, home=star.HOME))
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["q6_01_top_products_by_revenue", "q7_04_top_products_per_country", "q9_03_mart_product"])
def test_measures_are_not_aggregated_by_sorting_lines(spark, name):
    """A text minimum forces Spark to sort; it may only appear apart from the sums over all lines."""
    import __spark_entry__ as registry

    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    sorted_aggregates = [part for part in plan.split("\n\n") if "SortAggregate" in part and "Functions" in part]
    assert sorted_aggregates and not any("sum(" in part for part in sorted_aggregates)


def test_customers_are_not_ranked_in_one_task(spark):
    plan = plan_of(customers.rfm(star.sales_lines(spark, SF_DIR))).lower()
    assert "ntile" not in plan and "row_number" not in plan
