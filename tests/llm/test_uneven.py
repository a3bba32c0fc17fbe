"""Joins and components where one key holds most rows: the same rows, and no task that gathers them."""

import random

import pytest
from pyspark.sql import functions as F

from test_agreement import groups_by_brute_force
from tillroll.llm import common, simhash
from tillroll.llm.components import components


@pytest.fixture
def pairs(spark):
    rng = random.Random(2)
    keys = [7] * 3_000 + [8] * 1_500 + [rng.randrange(400) for _ in range(2_000)] + [None, 5_000]
    rows = spark.createDataFrame(list(enumerate(keys)), "id bigint, k bigint").repartition(4)
    grouped = rows.filter("k IS NOT NULL AND k < 1000").groupBy(F.col("k").alias("g")).agg(F.sum("id").alias("s"), F.count("*").alias("n"))
    return rows, common.saved(grouped, "grouped")


@pytest.mark.parametrize("hot, most", [(1_000, 20_000), (10, 3), (10**9, 20_000)])
def test_uneven_join_is_a_join(pairs, monkeypatch, hot, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    rows, grouped = pairs
    got = common.join_uneven(rows, grouped, "k", "g", "n", hot)
    expected = rows.join(grouped, F.col("k") == F.col("g")).select("id", "k", "s")
    assert got.columns == expected.columns and sorted(got.collect()) == sorted(expected.collect())


def test_hot_keys_stay_where_they_are(spark, pairs):
    rows, grouped = pairs
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = common.join_uneven(rows, grouped, "k", "g", "n")
        dealt = joined.select(F.spark_partition_id().alias("p"), "k").groupBy("p").count()
        # the rows of 7 and 8 lie in as many parts as before
        parts = joined.filter("k IN (7, 8)").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts == 4 and dealt.count() > 4


@pytest.mark.parametrize("hot", [2, 1_000])
def test_components_with_a_hub(spark, monkeypatch, hot):
    monkeypatch.setattr(common.join_uneven, "__defaults__", (hot,))
    rng = random.Random(hot)
    links = [(0, i) for i in range(1, 500)] + [(i, i + 1) for i in range(1_000, 1_300)] + [(9_000, 9_000)]
    links += [(a, b) for a, b in ((rng.randrange(2_000, 3_000), rng.randrange(2_000, 3_000)) for _ in range(700))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_one_bucket_and_one_component_of_all(spark, monkeypatch):
    """Prints that agree in most bits, in chunks of 16, and a hot print: the same groups as by brute force."""
    rng = random.Random(5)
    prints = [(i, (1 << rng.randrange(12)) | (1 << rng.randrange(12))) for i in range(300)]
    prints += [(1_000 + i, 0) for i in range(1_500)] + [(5_000 + i, rng.getrandbits(63)) for i in range(200)]
    df = spark.createDataFrame(prints, "doc_id bigint, fp bigint").repartition(3)
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda p, radius=4: real(p, radius, chunk=16))
    got = [(r["doc_id"], f"{r['fp']:016x}", r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == groups_by_brute_force(prints)
