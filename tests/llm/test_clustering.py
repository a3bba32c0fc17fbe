"""The nearest centroid and whole rounds against measuring every distance; awkward vectors."""

import hashlib

import numpy as np
import pytest

import __spark_entry__ as registry
from tillroll.llm import centroid_clustering as cc
from tillroll.llm import queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, ID string"


def plain(vectors, ids, k=40, rounds=5):
    """All distances of all rounds, in whole numbers."""
    x = np.floor(np.array(vectors, np.float64) * 256).astype(np.int64)
    hashes = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), tuple(v), n) for n, (i, v) in enumerate(zip(ids, x.tolist())) if i is not None)
    c = x[[n for *_, n in hashes[:k]]]

    def nearest():
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        a, _ = nearest()
        c = np.array([x[a == j].sum(axis=0) // (a == j).sum() if (a == j).any() else c[j] for j in range(len(c))])
    return *nearest(), c


@pytest.mark.parametrize("spread", [2, 40, 1 << 20])
def test_search_finds_what_all_distances_give(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (3_000, 64)) + rng.integers(-5 * spread, 5 * spread, (3_000, 1))
    c = x[:40].copy()
    c[7] = c[31] = c[2]  # ties go to the smaller number
    number, distance, measured = cc.Centroids.of(c).nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert measured < 0.6 * d.size  # vectors of different means are mostly refused unmeasured


def test_awkward_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = rng.normal(0, 0.3, (90, 64)).astype(np.float32).tolist()
    good[10] = good[11] = good[12]
    ids = [*range(80), *range(70, 78), None, None]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.5] * 63, [float("nan")] * 64, [float("inf")] + [0.5] * 63]
    rows = [(i, v, 0, "old", "old") for i, v in zip(ids, good)] + [(1000 + i, v, None, "old", "old") for i, v in enumerate(bad)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op11_clustering"](spark, str(tmp_path)).collect()
    number, distance, c = plain(good, ids)
    assert sorted((r["vec_id"] or -1, r["cluster"], r["distance"]) for r in got) == sorted(
        (-1 if i is None else i or -1, n, d) for i, n, d in zip(ids, number.tolist(), distance.tolist())
    )
    for r in got:
        text = ",".join(map(str, c[r["cluster"]].tolist()))
        assert r["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["cluster_inertia"] == distance[number == r["cluster"]].sum() and r["inertia"] == distance.sum()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, tmp_path, n):
    rows = [(i, [0.1 * i] * 64, 0, "old", "old") for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_clustering(spark, str(tmp_path)).collect()
    assert len(got) == n and {r["distance"] for r in got} <= {0} and len({r["cluster"] for r in got}) == n


def test_components_too_large_to_be_squared_are_refused(spark):
    rows = spark.createDataFrame([(1, [3e38] * 64), (2, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    with pytest.raises(ValueError, match="outgrow"):
        cc.clustered(rows)
