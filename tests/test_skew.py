"""Every report against its SQL on lines where one customer, product, order, country and month hold a third of all.

The lines also carry returns (negative amounts), missing customers and exact duplicates.
"""

import random

import duckdb
import pytest

import oracle
from compare import differences
from sample import line, sales
from tillroll.operators import concentration, customers, kpis, marts, products, quality, trends
from tillroll.sources.files import as_report

REPORTS = {
    "q2_01_table_shape": quality.table_shape,
    "q2_03_duplicate_summary": quality.duplicate_summary,
    "q2_04_rule_violations": quality.rule_violations,
    "q2_06_cardinality": quality.cardinality,
    "q2_07_nonconforming_codes": quality.nonconforming_codes,
    "q2_12_period_coverage": quality.period_coverage,
    "q3_01_headline_kpis": kpis.headline_kpis,
    "q3_02_repeat_kpis": kpis.repeat_kpis,
    "q3_03_yearly_sales": kpis.yearly_sales,
    "q3_04_describe_measures": kpis.describe_measures,
    "q3_05_describe_orders": kpis.describe_orders,
    "q4_01_monthly_sales": trends.monthly_sales,
    "q4_04_seasonality": trends.seasonality,
    "q4_08_best_days": trends.best_days,
    "q4_10_monthly_excluding_top_order": trends.monthly_excluding_top_orders,
    "q5_03_order_frequency_bands": customers.order_frequency_bands,
    "q5_04_value_quartiles": customers.value_quantiles,
    "q5_06_new_vs_returning": customers.new_vs_returning,
    "q5_07_purchase_span": customers.purchase_span,
    "q5_08_rfm": customers.rfm,
    "q5_10_cohort_retention": customers.cohort_retention,
    "q6_01_top_products_by_revenue": products.top_products_by_revenue,
    "q6_03_top_products_by_orders": products.top_products_by_orders,
    "q6_08_product_pareto": concentration.product_pareto,
    "q8_01_customer_pareto": concentration.customer_pareto,
    "q8_04_basket_pairs": concentration.basket_pairs,
    "q8_05_tukey_upper_lines": concentration.tukey_upper,
    "q8_06_largest_lines": concentration.largest_lines,
    "q8_07_sensitivity_top_order": concentration.sensitivity_top_order,
    "q8_08_sensitivity_dedup": concentration.sensitivity_dedup,
    "q9_02_mart_customer": marts.mart_customer,
    "q9_03_mart_product": marts.mart_product,
}


def skewed_lines():
    rng = random.Random(11)
    lines = []
    for i in range(3000):
        hot = rng.random() < 0.34
        month, day = (3, 5) if hot else (rng.randrange(1, 13), rng.randrange(1, 13))
        made = line(
            invoice="500" if hot and rng.random() < 0.5 else str(rng.randrange(1000, 1400)),
            code="10001" if hot else rng.choice(["POST", "M"]) if rng.random() < 0.05 else str(rng.randrange(10002, 10060)),
            description="hot" if hot else rng.choice(["cup", "bowl", "lamp"]),
            quantity=rng.choice([1, 2, 3, 12, -1]),
            price=f"{rng.choice([1, 2, 5, 9])}.{rng.randrange(100):02d}",
            customer=1 if hot else rng.randrange(2, 300),
            country="United Kingdom" if hot else rng.choice(["Spain", "France", "Eire"]),
            ts=f"{rng.choice([2010, 2011])}-{month:02d}-{day:02d} {rng.randrange(8, 20):02d}:00",
        )
        lines += [made] * (2 if rng.random() < 0.02 else 1)
    return lines


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skewed"))
    sales(spark, skewed_lines()).repartition(6).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW s AS SELECT * FROM '{path}/*.parquet'")
    return spark.read.parquet(path), con


@pytest.mark.parametrize("name", list(REPORTS))
def test_report_agrees_with_sql(skewed, name):
    s, con = skewed
    sql = oracle.statements()[name]
    mapping = f"s AS ({oracle.LINES.format(date='o_orderdate')})"
    assert mapping in sql
    sql = sql.replace(mapping, "unused AS (SELECT 1)")
    assert differences(as_report(REPORTS[name](s)), con, sql) == []
