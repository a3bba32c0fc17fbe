"""Neighbours found against all distances: recall, exact scores, copies, awkward vectors."""

import collections

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tillroll.llm import nearest_neighbours as nn
from tillroll.llm import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, cell string"


def plain(rows, k=10):
    """{query row: [(score, id), ...]} by all distances; ``rows``: (id, vector) of usable vectors."""
    x = np.array([v for _, v in rows], np.float64)
    out = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None and i % 100 == 0:
            d = np.sqrt(((x - x[n]) ** 2).sum(axis=1))
            near = sorted((d[j], rows[j][0] is None, rows[j][0] or 0) for j in range(len(rows)) if j != n)[:k]
            out[i].append([(s, None if none else j) for s, none, j in near])
    return out


def found(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    return out


@pytest.mark.parametrize("sf, n_queries", [("sf0.001", 5), ("sf0.1", 20)])
def test_recall_and_scores(spark, sf, n_queries):
    folder = f"/root/testdata/{sf}"
    table = pq.read_table(f"{folder}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    true = plain(rows)
    got = found(queries.op13_neighbours(spark, folder))
    assert set(got) == set(true) and len(got) == n_queries
    hits = 0
    for q, best in got.items():
        assert [r for r, _, _ in best] == list(range(1, 11))
        assert best == sorted(best, key=lambda x: x[1:])
        hits += len({i for _, _, i in best} & {i for _, i in true[q][0]})
        at = dict(rows)
        for _, score, i in best:
            assert score == np.sqrt(((np.array(at[i], np.float64) - np.array(at[q], np.float64)) ** 2).sum())
    assert hits >= 0.9 * 10 * n_queries


def test_a_forest_deeper_than_the_dimension_still_finds_structure():
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(200, 3)) * 50
    x = (centers[:, None] + rng.normal(size=(200, 40, 3))).reshape(-1, 3)
    forest = nn.Forest.fit(x, 3, 5)
    sizes = np.bincount(forest.cells(x)[:, 1] - forest.leaves, minlength=forest.leaves)
    assert sizes.min() > 0.9 * 250 and sizes.max() < 1.1 * 250  # medians halve every node
    assert nn.leaves_due(forest, x[rng.permutation(len(x))], len(x), 10, 0.95) < 20  # of 96
    q = x[17]
    assert sorted(forest.visited(q, 96)) == list(range(96))
    assert set(forest.cells(q[None])[0]) <= set(forest.visited(q, 12))


def test_copies_ties_and_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    one = rng.normal(size=8).tolist()
    rows = [(i, one) for i in range(0, 1_300, 7)] + [(i, rng.integers(-1, 2, 8).tolist()) for i in range(2_000, 2_400)]
    rows += [(100, one), (100, one), (None, one), (None, [1.0] * 8), (200, [1.0] * 8), (None, [1.0] * 8)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    bad = [None, [], [0.0] * 8, [1.0] * 9, [None] + [1.0] * 7, [float("nan")] * 8, [float("-inf")] + [0.0] * 7]
    table = [(i, v, 0, "old", "old") for i, v in rows + [(300 + 100 * n, v) for n, v in enumerate(bad)]]
    df = spark.createDataFrame(table, SCHEMA).repartition(7)
    got = nn.search(df, F.col("id") % 100 == 0, recall=1.0)
    usable = [(i, v) for i, v in rows if any(v)]
    true = plain(usable)
    by_query = found(got)
    assert set(by_query) == set(true)
    for q, lists in true.items():
        want = sorted((r + 1, s, i) for best in lists for r, (s, i) in enumerate(best))
        assert sorted(by_query[q], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [0, 1, 4])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(100 * i, [1.0, float(i)], 0, "", "") for i in range(n)], SCHEMA)
    got = found(nn.search(df, F.col("id") % 100 == 0))
    assert {q: len(best) for q, best in got.items()} == ({100 * i: n - 1 for i in range(n)} if n > 1 else {})


def test_equal_vectors_travel_as_a_few_rows(spark):
    """The hot vector is cut to its smallest ids within each task, before the shuffle."""
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    df = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    df = df.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64("vector", F.lit(1))})
    plan = nn.merged(df, 11)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    copies = spark.createDataFrame([(i, [1.0], 1, 2) for i in range(10)], "id long, vector array<double>, h1 long, h2 long")
    assert [r["ids"] for r in nn.merged(copies.repartition(3), 3).collect()] == [[0, 1, 2]]
