"""All reports by tag, each a function of a sales-line DataFrame with the default parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from tillroll.operators import concentration, customers, kpis, markets, marts, products, quality, trends
from tillroll.plans.grains import MART_READS, READS, Grains, write_grains
from tillroll.sources.files import export_results, file_stem

Report = Callable[[DataFrame], DataFrame]

# Titles; with the tags they make the names of the result files.
TITLES = {
    "Q2.1": "Table shape and date range",
    "Q2.2": "NULL / blank count for every column",
    "Q2.3": "Exact duplicate rows (all business columns identical)",
    "Q2.4": "Business-rule violations (should all be 0 in a cleaned file)",
    "Q2.5": "Internal consistency of derived columns (Year / Quarter / Month / Weekday)",
    "Q2.6": "Cardinality of the key dimensions",
    "Q2.7": "Stock codes that are NOT products (postage, fees, manual entries ...)",
    "Q2.8": "One StockCode mapped to several descriptions",
    "Q2.9": "Customers appearing in more than one country",
    "Q2.10": "Invoices spanning more than one timestamp or customer (should be 0)",
    "Q2.11": "Extreme values (outlier candidates)",
    "Q2.12": "Rows per month (reveals partial months)",
    "Q2.13": "Which days of the month are present? (coverage check)",
    "Q3.1": "Headline KPIs",
    "Q3.2": "Repeat-customer KPIs",
    "Q3.3": "Revenue by calendar year",
    "Q3.4": "Descriptive statistics at line level",
    "Q3.5": "Descriptive statistics at order level (value of a basket)",
    "Q4.1": "Monthly sales with month-over-month growth",
    "Q4.2": "Running total and 3-month moving average of revenue",
    "Q4.3": "Quarterly performance",
    "Q4.4": "Seasonality by calendar month (all years combined)",
    "Q4.5": "Revenue by weekday",
    "Q4.6": "Revenue by hour of the day",
    "Q4.7": "Day-part analysis",
    "Q4.8": "Ten best revenue days",
    "Q4.9": "Average daily revenue by month (adjusts for the different number of days with data)",
    "Q4.10": "Monthly revenue with and without the single largest order (outlier-adjusted trend)",
    "Q5.1": "Top 10 customers by revenue",
    "Q5.2": "Top 10 customers by number of orders",
    "Q5.3": "Distribution of customers by number of orders",
    "Q5.4": "Value segments - customers split into revenue quartiles",
    "Q5.5": "Repeat vs one-time customers",
    "Q5.6": "New vs returning customers each month",
    "Q5.7": "Time between a customer's first and last purchase (repeat customers only)",
    "Q5.9": "RFM segment summary",
    "Q5.10": "Monthly cohort retention (% of a cohort that is active N months later)",
    "Q6.1": "Top 10 products by revenue",
    "Q6.2": "Top 10 products by quantity sold",
    "Q6.3": "Top 10 most popular products (appear in most orders)",
    "Q6.4": "Ten lowest-revenue products that sold at least 10 units",
    "Q6.5": "Unit-price bands",
    "Q6.6": "Revenue from non-product codes (postage, manual entries, fees)",
    "Q6.7": "Products sold in the most countries",
    "Q6.8": "Product concentration (Pareto) - how many products make 80% of revenue?",
    "Q6.9": "Items with a very high price but low volume (premium items)",
    "Q7.1": "Country league table",
    "Q7.2": "United Kingdom vs rest of the world",
    "Q7.3": "Repeat-customer rate by country (countries with 20+ customers)",
    "Q7.4": "Top-3 products in each of the 5 biggest international markets",
    "Q7.5": "Monthly revenue - UK vs International",
    "Q8.1": "Customer concentration (Pareto) - share of revenue from top customers",
    "Q8.2": "Order-value bands",
    "Q8.3": "Basket size - number of distinct products per order",
    "Q8.4": "Products most often bought together (market-basket pairs)",
    "Q8.5": "Outliers by IQR rule on line revenue (Tukey fences)",
    "Q8.6": "The 10 largest single line items",
    "Q8.7": "Sensitivity - KPIs with and without the single largest order",
    "Q8.8": "Sensitivity - impact of removing exact duplicate rows",
    "Q8.9": "Correlation between unit price and quantity (Pearson, line level)",
    "Q8.10": "Invoices that carry more than one timestamp (the 8 cases)",
    "Q9.5": "Smoke test - views return data",
}


def _several_countries(s: DataFrame) -> DataFrame:
    return quality.fd_violations(s, "CustomerID", "Country", "countries", limit=None)


def _by_orders(s: DataFrame) -> DataFrame:
    return customers.top_customers(s, by="orders")


def _rfm_summary(s: DataFrame) -> DataFrame:
    return customers.rfm_summary(customers.rfm(s))


def _mart_counts(s: DataFrame) -> DataFrame:
    return marts.mart_counts({name: build(s) for name, build in marts.MARTS.items()})


REPORTS: dict[str, Report] = {
    "Q2.1": quality.table_shape,
    "Q2.2": quality.null_blank_counts,
    "Q2.3": quality.duplicate_summary,
    "Q2.4": quality.rule_violations,
    "Q2.5": quality.calendar_consistency,
    "Q2.6": quality.cardinality,
    "Q2.7": quality.nonconforming_codes,
    "Q2.8": quality.fd_violations,
    "Q2.9": _several_countries,
    "Q2.10": quality.fd_violation_counts,
    "Q2.11": quality.flag_extremes,
    "Q2.12": quality.period_coverage,
    "Q2.13": quality.day_of_month_coverage,
    "Q3.1": kpis.headline_kpis,
    "Q3.2": kpis.repeat_kpis,
    "Q3.3": kpis.yearly_sales,
    "Q3.4": kpis.describe_measures,
    "Q3.5": kpis.describe_orders,
    "Q4.1": trends.monthly_sales,
    "Q4.2": trends.running_and_moving,
    "Q4.3": trends.quarterly_sales,
    "Q4.4": trends.seasonality,
    "Q4.5": trends.weekday_sales,
    "Q4.6": trends.hourly_sales,
    "Q4.7": trends.day_part_sales,
    "Q4.8": trends.best_days,
    "Q4.9": trends.revenue_per_active_day,
    "Q4.10": trends.monthly_excluding_top_orders,
    "Q5.1": customers.top_customers,
    "Q5.2": _by_orders,
    "Q5.3": customers.order_frequency_bands,
    "Q5.4": customers.value_quantiles,
    "Q5.5": customers.repeat_vs_onetime,
    "Q5.6": customers.new_vs_returning,
    "Q5.7": customers.purchase_span,
    "Q5.9": _rfm_summary,
    "Q5.10": customers.cohort_retention,
    "Q6.1": products.top_products_by_revenue,
    "Q6.2": products.top_products_by_quantity,
    "Q6.3": products.top_products_by_orders,
    "Q6.4": products.bottom_products,
    "Q6.5": products.price_bands,
    "Q6.6": products.code_type_split,
    "Q6.7": products.top_products_by_countries,
    "Q6.8": concentration.product_pareto,
    "Q6.9": products.premium_products,
    "Q7.1": markets.country_league,
    "Q7.2": markets.home_vs_rest,
    "Q7.3": markets.repeat_rate_by,
    "Q7.4": markets.top_products_per_country,
    "Q7.5": markets.monthly_home_vs_rest,
    "Q8.1": concentration.customer_pareto,
    "Q8.2": concentration.order_value_bands,
    "Q8.3": concentration.basket_size_bands,
    "Q8.4": concentration.basket_pairs,
    "Q8.5": concentration.tukey_upper,
    "Q8.6": concentration.largest_lines,
    "Q8.7": concentration.sensitivity_top_order,
    "Q8.8": concentration.sensitivity_dedup,
    "Q8.9": concentration.correlation,
    "Q8.10": quality.fd_violation_detail,
    "Q9.5": _mart_counts,
}
# Their size grows with the number of customers or invoices: written by many tasks, not into one file.
GROWING = {"Q2.7", "Q2.9", "Q8.10"}


def marts_from(grains: Grains) -> dict[str, DataFrame]:
    """Every mart, from the sums that hold all it counts."""
    return {name: build(getattr(grains, MART_READS[name])) for name, build in marts.MARTS.items()}


def report_from(tag: str, grains: Grains) -> DataFrame:
    """A report, from the lines or from the sums that hold all it counts (``grains.READS``)."""
    if READS[tag] == "marts":
        return marts.mart_counts(marts_from(grains))
    return REPORTS[tag](getattr(grains, READS[tag]))


def export_reports(
    s: DataFrame, out_dir: str, tags: Iterable[str] | None = None, grain_dir: str | None = None
) -> list[str]:
    """Run the reports (all by default) on a sales table and write each as CSV, replacing earlier results.

    With ``grain_dir``, a folder that all executors share, the lines are first summed there per order and per order and
    product, and most reports read those sums. That pays off for many reports at a time.
    """
    grains = write_grains(s, grain_dir) if grain_dir else None
    paths = []
    for tag in REPORTS if tags is None else tags:
        name = file_stem(tag, TITLES[tag])
        report = report_from(tag, grains) if grains else REPORTS[tag](s)
        paths += export_results({name: report}, out_dir, one_file=tag not in GROWING)
    return paths
