"""Counts from merged sketches against exact ones; activity bits against plain sets of months."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from sample import line, sales
from tillroll.operators import customers, rollups
from tillroll.functions.metrics import measured


@pytest.fixture(scope="module")
def many(spark):
    """12,000 customers who buy in several months of two years, a third of all lines by one of them."""
    rows = spark.range(60_000).select(
        F.col("id").cast("string").alias("InvoiceNo"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(12_000))).alias("CustomerID"),
        F.concat(F.lit("1"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3_000)).cast("string")).alias("StockCode"),
        F.lit("France").alias("Country"),
        F.lit(1).cast("bigint").alias("Quantity"),
        F.lit("1.25").cast("decimal(18,4)").alias("Revenue"),
        F.expr("date '2010-01-01' + int(pmod(xxhash64(id, 2), 730))").alias("day"),
    )
    day = F.col("day")
    return rows.withColumns(
        {
            "YearMonth": F.date_format(day, "yyyy-MM"),
            "Year": F.year(day),
            "Quarter": F.quarter(day),
            "MonthNum": F.month(day),
            "MonthName": F.date_format(day, "MMMM"),
        }
    ).cache()


@pytest.mark.parametrize("keys", [["Year"], ["Year", "Quarter"], []])
@pytest.mark.parametrize("lg_k", [10, 12])
def test_counts_of_coarser_spans_keep_within_the_stated_error(many, keys, lg_k):
    mart = rollups.mart_monthly_sketched(many, lg_k)
    got = rollups.checked(rollups.rolled_up(mart, keys), measured(many, keys, list(rollups.COUNTED)), keys, lg_k).collect()
    assert got and all(r[f"{m}_within"] for r in got for m in rollups.COUNTED)


def test_adding_up_monthly_counts_would_be_wrong(many):
    mart = rollups.mart_monthly_sketched(many)
    added = {r["Year"]: r["n"] for r in mart.groupBy("Year").agg(F.sum("customers").alias("n")).collect()}
    true = {r["Year"]: r["customers"] for r in measured(many, ["Year"], ["customers"]).collect()}
    estimated = {r["Year"]: r["customers_estimate"] for r in rollups.by_year(mart).collect()}
    for year, n in true.items():
        assert added[year] > 1.5 * n and abs(estimated[year] - n) <= rollups.stated_error() * n


def test_a_stored_mart_gives_the_same(spark, many, tmp_path):
    mart = rollups.mart_monthly_sketched(many)
    mart.write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(rollups.by_quarter(stored).collect()) == sorted(rollups.by_quarter(mart).collect())


def test_empty_and_missing(spark):
    none = rollups.rolled_up(rollups.mart_monthly_sketched(sales(spark, []))).collect()
    assert len(none) == 1 and none[0]["customers_estimate"] in (0, None)
    gaps = sales(spark, [line(customer=None), line(customer=3), tuple([None] * 17)])
    assert rollups.rolled_up(rollups.mart_monthly_sketched(gaps)).first()["customers_estimate"] == 1


def month(n):
    return f"{(n - 1) // 12:04}-{(n - 1) % 12 + 1:02}"


def test_activity_bits(spark):
    rng = random.Random(3)
    first = 12 * 1990 + 1
    active = {c: sorted({first + rng.choice([0, 61, 62, 63, 124, rng.randrange(492), 491]) for _ in range(9)}) for c in range(60)}
    lines = [line(customer=c, ts=f"{month(m)}-03 10:00") for c, months in active.items() for m in months for _ in range(2)]
    s = sales(spark, lines + [line(customer=None)]).repartition(3)
    assert {r["CustomerID"]: r["months"] for r in customers.active_months(s).collect()} == active
    gaps = collections.Counter(b - a for months in active.values() for a, b in zip(months, months[1:]))
    got = {r["gap_months"]: r["gaps"] for r in customers.purchase_gaps(s).collect()}
    assert got == gaps
    for offset in (1, 62, 200):
        kept = collections.defaultdict(list)
        for months in active.values():
            kept[month(months[0])].append(months[0] + offset in months)
        shown = {r["cohort"]: r[f"m{offset}_pct"] for r in customers.cohort_retention(s, [offset]).collect()}
        assert shown == pytest.approx({c: 100 * sum(x) / len(x) for c, x in kept.items()}, abs=0.051)


def test_one_row_per_customer_is_shuffled(spark):
    s = sales(spark, [line(customer=1, ts=f"2011-{m:02}-01 09:00") for m in range(1, 13)])
    plan = customers.cohort_retention(s)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert shuffles and not any("YearMonth" in x for x in shuffles)


def test_months_out_of_range_are_loud(spark):
    with pytest.raises(Exception, match="not from 1990-01 to 2030-12"):
        customers.active_months(sales(spark, [line(ts="1989-12-31 10:00")])).collect()
    early = customers.active_months(sales(spark, [line(ts="1989-12-31 10:00")]), "1980-01", "1989-12").collect()
    assert early[0]["months"] == [12 * 1989 + 12]
