
from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

import oracle
from tillroll.operators import concentration, customers, itemsets, kpis, markets, marts, products, quality, rollups, trends
from tillroll.functions.metrics import measured
from tillroll.plans import grains
from tillroll.plans.catalogue import marts_from, report_from
from tillroll.sources import star
from tillroll.sources.files import as_report, prepare_sales, rejected_lines

try:  # the training-data operators, where they are installed
    import corpus_pipeline
    from tillroll.llm import queries as training
except ImportError as missing:
    if (missing.name or "").split(".")[:2] not in (["corpus_pipeline"], ["tillroll", "llm"]):
        raise
    corpus_pipeline = training = None

SMOKE_DIR = "/root/testdata/sf0.001"

# Parameters that suit the amounts of the test tables; the SQL uses the same.
PRICE_EDGES = (500, 1000, 2500, 5000, 10000)
ORDER_VALUE_EDGES = (75000, 125000, 200000, 300000, 400000)
BASKET_TOPS = (1, 2, 4, 6, 8)


def _extremes():
    return {
        "Quantity > 45": F.col("Quantity") > 45,
        "UnitPrice > 10000": F.col("UnitPrice") > 10000,
        "Line revenue > 100000": F.col("Revenue") > 100000,
        "UnitPrice < 100": F.col("UnitPrice") < 100,
        "UnitPrice < 0": F.col("UnitPrice") < 0,
    }


def _shipped_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Stored year, quarter, month and weekday of the shipping date, next to the day of the order."""
    s = star.sales_lines(spark, d, dated_by="l_shipdate")
    return s.withColumn("InvoiceDay", F.col("o_orderdate").cast("date"))


def _order_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Lines reduced to order and line number, which repeat, so that duplicates exist."""
    return star.sales_lines(spark, d, orders=False)


def _brands(spark: SparkSession, d: str) -> DataFrame:
    s = star.sales_lines(spark, d, orders=False, parts=True)
    return s.withColumns({"StockCode": F.col("Brand"), "Description": F.upper("Brand")})


def _names_as_codes(spark: SparkSession, d: str) -> DataFrame:
    s = star.sales_lines(spark, d, orders=False, parts=True)
    return s.withColumns({"StockCode": F.col("Description"), "Description": F.col("Brand")})


def _codes_with_gaps(s: DataFrame) -> DataFrame:
    """Blank out some text and some numbers, by content, to give the blank counts something to find."""
    return s.withColumns(
        {
            "Description": F.when(F.col("Description").startswith("hot"), "  ").otherwise(F.col("Description")),
            "Country": F.when(F.col("Country") == star.HOME, None).otherwise(F.col("Country")),
            "Quantity": F.when(F.col("Quantity") != 13, F.col("Quantity")),
        }
    )


def _customer_gaps(s: DataFrame) -> DataFrame:
    """Every seventh customer has no revenue at all."""
    return s.withColumn("Revenue", F.when(F.col("CustomerID") % 7 != 0, F.col("Revenue")))


def _code_gaps(s: DataFrame) -> DataFrame:
    return s.withColumn("Revenue", F.when(~F.col("StockCode").endswith("7"), F.col("Revenue")))


def _fine_money(s: DataFrame) -> DataFrame:
    """Money with four decimals."""
    fine = F.col("Revenue") + F.col("l_linenumber") * F.lit(Decimal("0.0007"))
    return s.withColumn("Revenue", fine.cast("decimal(18,4)"))


def _set_texts(sets: DataFrame) -> DataFrame:
    return sets.withColumn("items", F.concat_ws(" + ", "items"))


def _several_names(s: DataFrame) -> DataFrame:
    """Small lines have another name, so that a code's first name is not always its usual one."""
    return s.withColumn("Description", F.when(F.col("Quantity") < 15, F.lit("A sample")).otherwise(F.col("Description")))


def _spoilt(raw: DataFrame) -> DataFrame:
    """Text lines of which some have no date, and some a price that is no number."""
    return raw.withColumns(
        {
            "InvoiceDate": F.when(F.col("Quantity") == "13", "unknown").otherwise(F.col("InvoiceDate")),
            "UnitPrice": F.when(F.col("Quantity") == "17", "n/a").otherwise(F.col("UnitPrice")),
        }
    )


def _rejected(raw: DataFrame) -> DataFrame:
    return rejected_lines(_spoilt(raw)).select("InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every operator on the test tables; a query joins only the dimensions whose columns it uses."""

    def on(lines: Callable[[SparkSession, str], DataFrame], operator: Callable[[DataFrame], DataFrame]):
        return lambda spark, d: as_report(operator(lines(spark, d)))

    def plain(spark, d):
        return star.sales_lines(spark, d, orders=False)

    def dated(spark, d):
        return star.sales_lines(spark, d)

    def placed(spark, d):
        return star.sales_lines(spark, d, countries=True)

    def named(spark, d):
        return star.sales_lines(spark, d, orders=False, parts=True)

    def named_orders(spark, d):
        return star.sales_lines(spark, d, parts=True)

    def full(spark, d):
        return star.sales_lines(spark, d, countries=True, parts=True)

    def by_order(spark, d):
        return star.sales_lines(spark, d, countries=True, parts=True, orders_last=True)

    def shipped(spark, d):
        return star.sales_lines(spark, d, dated_by="l_shipdate")

    def supplied(spark, d):
        return star.with_supplier_country(spark, d, star.sales_lines(spark, d))

    def line_numbers(s):
        return quality.duplicate_summary(s, ["l_orderkey", "l_linenumber"])

    def with_names(lines, operator):
        """Names come from the table of parts, which the lines then need not meet: they are never shuffled by part."""
        return lambda spark, d: as_report(operator(lines(spark, d), names=star.product_names(spark, d)))

    def usual(lines, operator):
        return on(lines, lambda s: operator(_several_names(s), label="mode"))

    def shared(tag: str):
        return lambda s: report_from(tag, grains.grains_of(s))

    def rolled(mart, roll, keys: list[str]):
        """Sums and counts of coarser groups from a sketched mart, beside the exact counts from the lines."""

        def query(s: DataFrame) -> DataFrame:
            counted = ["orders", "customers", "products", *([] if mart is rollups.mart_country_sketched else ["countries"])]
            split = s.withColumn("market", F.when(F.col("Country") == star.HOME, star.HOME).otherwise("International"))
            return rollups.checked(roll(mart(s)), measured(split, keys, counted), keys)

        return query

    home = star.HOME
    return {
        "q9_01_year_from_months": on(full, rolled(rollups.mart_monthly_sketched, rollups.by_year, ["Year"])),
        "q9_01_quarter_from_months": on(full, rolled(rollups.mart_monthly_sketched, rollups.by_quarter, ["Year", "Quarter"])),
        "q3_01_totals_from_months": on(full, rolled(rollups.mart_monthly_sketched, rollups.rolled_up, [])),
        "q9_04_market_from_countries": on(
            full, rolled(rollups.mart_country_sketched, lambda m: rollups.by_market(m, star.HOME), ["market"])
        ),
        "q5_10_purchase_gaps": on(dated, customers.purchase_gaps),
        "s7_grain_control": on(by_order, lambda s: grains.control(grains.grains_of(s, together=True))),
        "s7_monthly_sales_from_sums": on(full, shared("Q4.1")),
        "s7_headline_kpis_from_sums": on(full, shared("Q3.1")),
        "s7_rfm_summary_from_sums": on(full, shared("Q5.9")),
        "s7_top_products_by_orders_from_sums": on(full, shared("Q6.3")),
        "s7_premium_products_from_sums": on(full, shared("Q6.9")),
        "s7_country_league_from_sums": on(full, shared("Q7.1")),
        "s7_mart_product_from_sums": on(full, lambda s: marts_from(grains.grains_of(s))["vw_product_summary"]),
        "s2_prepare_sales": on(star.raw_lines, prepare_sales),
        "s2_rejected_lines": on(star.raw_lines, _rejected),
        "q2_01_table_shape": on(dated, quality.table_shape),
        "q2_02_null_blank_counts": on(full, lambda s: quality.null_blank_counts(_codes_with_gaps(s))),
        "q2_03_duplicate_summary": on(full, quality.duplicate_summary),
        "q2_03_duplicate_line_numbers": on(plain, line_numbers),
        "q2_04_rule_violations": on(plain, quality.rule_violations),
        "q2_05_calendar_consistency": on(_shipped_calendar, quality.calendar_consistency),
        "q2_06_cardinality": on(full, quality.cardinality),
        "q2_07_nonconforming_codes": with_names(plain, quality.nonconforming_codes),
        "q2_08_code_descriptions": on(_names_as_codes, quality.fd_violations),
        "q2_09_customer_countries": on(
            supplied, lambda s: quality.fd_violations(s, "CustomerID", "Country", "countries", limit=None)
        ),
        "q2_10_invoice_dependencies": on(shipped, quality.fd_violation_counts),
        "q2_11_flag_extremes": on(plain, lambda s: quality.flag_extremes(s, _extremes())),
        "q2_12_period_coverage": on(dated, quality.period_coverage),
        "q2_13_day_of_month_coverage": on(dated, quality.day_of_month_coverage),
        "q3_01_headline_kpis": on(placed, kpis.headline_kpis),
        "q3_02_repeat_kpis": on(dated, kpis.repeat_kpis),
        "q3_03_yearly_sales": on(dated, kpis.yearly_sales),
        "q3_04_describe_measures": on(plain, kpis.describe_measures),
        "q3_05_describe_orders": on(plain, kpis.describe_orders),
        "q3_05_describe_orders_fine_money": on(plain, lambda s: kpis.describe_orders(_fine_money(s))),
        "q4_01_monthly_sales": on(dated, trends.monthly_sales),
        "q4_02_running_and_moving": on(dated, trends.running_and_moving),
        "q4_03_quarterly_sales": on(dated, trends.quarterly_sales),
        "q4_04_seasonality": on(dated, trends.seasonality),
        "q4_05_weekday_sales": on(dated, trends.weekday_sales),
        "q4_06_hourly_sales": on(star.event_lines, trends.hourly_sales),
        "q4_07_day_part_sales": on(star.event_lines, trends.day_part_sales),
        "q4_08_best_days": on(dated, trends.best_days),
        "q4_09_revenue_per_active_day": on(dated, trends.revenue_per_active_day),
        "q4_10_monthly_excluding_top_order": on(dated, trends.monthly_excluding_top_orders),
        "q5_01_top_customers_by_revenue": on(placed, customers.top_customers),
        "q5_02_top_customers_by_orders": on(placed, lambda s: customers.top_customers(s, by="orders")),
        "q5_03_order_frequency_bands": on(dated, customers.order_frequency_bands),
        "q5_04_value_quartiles": on(dated, customers.value_quantiles),
        "q5_04_value_quartiles_gaps": on(dated, lambda s: customers.value_quantiles(_customer_gaps(s))),
        "q5_04_value_deciles": on(dated, lambda s: customers.value_quantiles(s, 10)),
        "q5_05_repeat_vs_onetime": on(dated, customers.repeat_vs_onetime),
        "q5_06_new_vs_returning": on(dated, customers.new_vs_returning),
        "q5_07_purchase_span": on(dated, customers.purchase_span),
        "q5_08_rfm": on(dated, customers.rfm),
        "q5_08_rfm_snapshot": on(dated, lambda s: customers.rfm(s, snapshot=F.lit("2001-01-01").cast("date"))),
        "q5_09_rfm_summary": on(dated, lambda s: customers.rfm_summary(customers.rfm(s))),
        "q5_10_cohort_retention": on(dated, customers.cohort_retention),
        "q5_10_cohort_retention_censored": on(dated, lambda s: customers.cohort_retention(s, censor=True)),
        "q6_01_top_products_by_revenue": with_names(plain, products.top_products_by_revenue),
        "q6_01_usual_names": usual(named, products.top_products_by_revenue),
        "q6_02_top_products_by_quantity": with_names(plain, products.top_products_by_quantity),
        "q6_03_top_products_by_orders": with_names(dated, products.top_products_by_orders),
        "q6_04_bottom_products": with_names(plain, products.bottom_products),
        "q6_05_price_bands": on(plain, lambda s: products.price_bands(s, PRICE_EDGES, 1)),
        "q6_06_code_type_split": on(plain, products.code_type_split),
        "q6_07_top_products_by_countries": with_names(placed, products.top_products_by_countries),
        "q6_08_product_pareto": on(plain, concentration.product_pareto),
        "q6_08_product_pareto_gaps": on(plain, lambda s: concentration.product_pareto(_code_gaps(s))),
        "q6_09_premium_products": with_names(plain, products.premium_products),
        "q7_01_country_league": on(placed, markets.country_league),
        "q7_02_home_vs_rest": on(placed, lambda s: markets.home_vs_rest(s, home)),
        "q7_03_repeat_rate_by_country": on(placed, markets.repeat_rate_by),
        "q7_04_top_products_per_country": with_names(
            placed, lambda s, names: markets.top_products_per_country(s, home=home, names=names)
        ),
        "q7_05_monthly_home_vs_rest": on(placed, lambda s: markets.monthly_home_vs_rest(s, home)),
        "q8_01_customer_pareto": on(dated, concentration.customer_pareto),
        "q8_01_customer_pareto_gaps": on(dated, lambda s: concentration.customer_pareto(_customer_gaps(s))),
        "q8_02_order_value_bands": on(plain, lambda s: concentration.order_value_bands(s, ORDER_VALUE_EDGES)),
        "q8_03_basket_size_bands": on(plain, lambda s: concentration.basket_size_bands(s, BASKET_TOPS)),
        "q8_04_basket_pairs": with_names(plain, concentration.basket_pairs),
        "q8_04_brand_pairs": on(_brands, lambda s: concentration.basket_pairs(s, pattern=None)),
        "q8_04_frequent_sets": on(_brands, lambda s: _set_texts(itemsets.frequent_itemsets(s, 0.006, 3, None))),
        "q8_04_frequent_product_sets": on(plain, lambda s: _set_texts(itemsets.frequent_itemsets(s, 0.0001, 3))),
        "q8_05_tukey_upper": on(star.event_lines, concentration.tukey_upper),
        "q8_05_tukey_upper_lines": on(plain, concentration.tukey_upper),
        "q8_06_largest_lines": on(full, concentration.largest_lines),
        "q8_07_sensitivity_top_order": on(plain, concentration.sensitivity_top_order),
        "q8_08_sensitivity_dedup": on(full, concentration.sensitivity_dedup),
        "q8_08_sensitivity_dedup_line_numbers": on(
            plain, lambda s: concentration.sensitivity_dedup(s, ["l_orderkey", "l_linenumber"])
        ),
        "q8_09_correlation": on(plain, concentration.correlation),
        "q8_10_invoice_timestamps": on(shipped, quality.fd_violation_detail),
        "q9_01_mart_monthly": on(dated, marts.mart_monthly),
        "q9_02_mart_customer": on(placed, marts.mart_customer),
        "q9_03_mart_product": with_names(dated, marts.mart_product),
        "q9_03_usual_names": usual(named_orders, marts.mart_product),
        "q9_04_mart_country": on(placed, marts.mart_country),
        "q9_05_mart_counts": on(
            full, lambda s: marts.mart_counts({name: build(s) for name, build in marts.MARTS.items()})
        ),
        "x1_top_international": on(placed, lambda s: markets.top_international(s, home=home)),
        **_training_queries(),
    }


def _training_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**training.queries(), "pipeline": corpus_pipeline.run} if training else {}


def _training_sql() -> dict[str, str]:
    if not training:
        return {}
    whole = corpus_pipeline.ORACLE_SQL
    return {**training.oracle_sql(), **({"pipeline": whole} if whole else {})}


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: monthly sales with growth over the previous month."""
    return queries()["q4_01_monthly_sales"](spark, SMOKE_DIR)


def oracle_sql() -> dict[str, str]:
    return {**oracle.statements(), **_training_sql()}
