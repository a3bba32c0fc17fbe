"""Rank operators against plain windows, on data full of ties."""

import random

import pytest
from pyspark.sql import Window, functions as F

from tillroll.operators.ranks import LOWEST, leading_digits, rows_at_ranks, running_totals, with_ntiles


def test_leading_digits_keep_order(spark):
    rng = random.Random(1)
    values = {0, 1, -1, 9, 10, 99, 100, 9999, 10000, -9999, -10000, LOWEST, 9 * 10**18}
    values |= {rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 18)) for _ in range(2000)}
    rows = spark.createDataFrame([(v,) for v in values], "v BIGINT").select("v", leading_digits(F.col("v")).alias("b"))
    buckets = [r.b for r in sorted(rows.collect())]
    assert buckets == sorted(buckets)


def tied_rows(spark, n, seed):
    rng = random.Random(seed)
    # a third of the rows share one value; values of very different sizes and signs

    def value():
        return 7 if rng.random() < 0.34 else rng.randrange(-50, 50) * 10 ** rng.randrange(0, 9)

    rows = [(i, value(), rng.randrange(3)) for i in range(n)]
    return spark.createDataFrame(rows, "id BIGINT, v BIGINT, g INT")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 8, 1000])
def test_ntiles_equal_plain_window(spark, n):
    df = tied_rows(spark, n, n)
    orders = {"a": [F.col("v"), F.col("id")], "b": [F.col("g"), -F.col("v"), F.col("id")]}
    got = with_ntiles(df, 5, orders)
    plain = df.withColumns(
        {name: F.ntile(5).over(Window.partitionBy().orderBy(*cols)) for name, cols in orders.items()}
    )
    assert sorted(got.collect()) == sorted(plain.collect())


def test_identifiers_with_common_first_digits(spark):
    df = tied_rows(spark, 500, 5).withColumn("id", F.col("id") * 7 + 10_000_000_000)
    orders = {"a": [F.col("v"), F.col("id")], "b": [F.col("id")], "c": [F.col("g"), F.col("v"), -F.col("id")]}
    got = with_ntiles(df, 7, orders)
    plain = df.withColumns(
        {name: F.ntile(7).over(Window.partitionBy().orderBy(*cols)) for name, cols in orders.items()}
    )
    assert sorted(got.collect()) == sorted(plain.collect())


def test_ntiles_put_missing_values_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -5), (4, None)], "id BIGINT, v BIGINT")
    got = {r.id: r.t for r in with_ntiles(df, 4, {"t": [F.col("v"), F.col("id")]}).collect()}
    assert got == {1: 1, 4: 2, 3: 3, 2: 4}


@pytest.mark.parametrize("merge_equal", [False, True])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 500])
def test_rows_at_ranks(spark, n, merge_equal):
    df = tied_rows(spark, n, 100 + n)
    targets = {"low": lambda c: F.floor((c + 1) / 2), "third": lambda c: F.floor(c * F.lit(0.75)) + 1}
    found = rows_at_ranks(df, ["v"], targets, by=["g"], merge_equal=merge_equal)
    got = {(r.g, r.target): r.v for r in found.collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r.v)
    expected = {}
    for g, values in groups.items():
        values.sort()
        expected[g, "low"] = values[(len(values) + 1) // 2 - 1]
        expected[g, "third"] = values[int(len(values) * 0.75)]
    assert got == expected


def test_running_totals_equal_plain_window(spark):
    df = tied_rows(spark, 800, 3).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("w"))
    got = running_totals(df, "v", ["n", "w"]).select("v", "n_upto", "w_upto", "n_all", "w_all")
    w, all_rows = Window.partitionBy().orderBy("v"), Window.partitionBy()
    plain = df.select(
        "v", F.sum("n").over(w).alias("n_upto"), F.sum("w").over(w).alias("w_upto"),
        F.sum("n").over(all_rows).alias("n_all"), F.sum("w").over(all_rows).alias("w_all"),
    )
    assert sorted(got.collect()) == sorted(plain.collect())
