"""Exact k-means over integer vectors: equal-average equal-variance search for the nearest centroid.

A vector x of m components has the sum S(x) and the deviation V(x), the length of x minus its mean. For every centroid c

    m * |x - c|^2 >= (S(x) - S(c))^2        and        |x - c|^2 >= (S(x) - S(c))^2 / m + (V(x) - V(c))^2,

so centroids sorted by their sum are looked at from the vector's own sum outward, in both directions. Once the first
inequality refuses the nearer side it refuses everything beyond, and the search ends; the second one refuses single
centroids. Only what both let through is measured, in whole numbers.

Rows stay where they are: each round is one scan in which a task assigns its rows and sums them up by centroid, and the
sums of all tasks are grouped by (centroid, component). Centroids (k times the dimension) are all that travels. A lost
task is computed again with the same result, as nothing depends on the order or the place of rows.

Defined cases: vectors that are null, of another length, or hold null, NaN or infinite components take no part. Repeated
rows count each time. Rows without an id are assigned like others, but do not start a centroid. Starting rows of the same
id follow in the order of their components. With fewer than k rows to start from there are fewer centroids; without any,
the result is empty. Components must be below 2^26 in size once scaled, else squared distances outgrow a BIGINT: that
raises an error. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import saved, usable

LARGEST = 1 << 26
# rows that a task works on at a time
BLOCK = 8_192
# room for the rounding of square roots, far above it and far below the smallest difference that matters
SLACK = 1e-6


@dataclass
class Centroids:
    """Centroids in the order of their sums, ready to be searched."""

    rows: np.ndarray  # k x dim, whole numbers, in the order of the sums
    number: np.ndarray  # of each of those rows
    sums: np.ndarray
    deviation: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray) -> Centroids:
        order = np.argsort(vectors.sum(axis=1), kind="stable")
        rows = vectors[order]
        sums = rows.sum(axis=1)
        return cls(rows, order.astype(np.int32), sums, _deviation(rows, sums))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of and squared distance to every row's nearest centroid (ties: the smaller number); and the distances measured."""
        n, dim = x.shape
        k = len(self.rows)
        sums = x.sum(axis=1)
        deviation = _deviation(x, sums)
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k, np.int32)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        todo = np.arange(n)
        measured = 0
        far = np.iinfo(np.int64).max
        while len(todo):
            # the side whose next centroid is nearer in its sum
            lo, hi = left[todo], right[todo]
            to_left = np.where(lo >= 0, sums[todo] - self.sums[np.maximum(lo, 0)], far)
            to_right = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[todo], far)
            go_left = to_left <= to_right
            gap = np.where(go_left, to_left, to_right)
            at = np.where(go_left, lo, hi)
            # sums differ by more than 2^31 only where the bound lies beyond every distance there can be
            open_ = (gap != far) & (gap.astype(np.float64) ** 2 <= dim * best[todo].astype(np.float64) * (1 + SLACK) + SLACK)
            todo, at, gap, go_left = todo[open_], at[open_], gap[open_], go_left[open_]
            left[todo[go_left]] -= 1
            right[todo[~go_left]] += 1
            bound = gap.astype(np.float64) ** 2 / dim + (deviation[todo] - self.deviation[at]) ** 2
            close = bound <= best[todo].astype(np.float64) * (1 + SLACK) + SLACK
            rows, at = todo[close], at[close]
            measured += len(rows)
            apart = x[rows] - self.rows[at]
            distance = np.einsum("ij,ij->i", apart, apart)
            better = (distance < best[rows]) | ((distance == best[rows]) & (self.number[at] < number[rows]))
            best[rows[better]] = distance[better]
            number[rows[better]] = self.number[at[better]]
        return number, best, measured


def _deviation(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", rows, rows).astype(np.float64)
    return np.sqrt(np.maximum(squares - sums.astype(np.float64) ** 2 / rows.shape[1], 0))


def whole_numbers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, x as double, one row a vector."""
    components = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scaled = np.floor(components * scale)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"a component of {np.abs(scaled).max():.3g} once scaled: squared distances outgrow a BIGINT")
    return scaled.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def starts(rows: DataFrame, k: int, seed: int, dim: int, scale: int) -> np.ndarray:
    """The k rows with the smallest SHA-256 of '<seed>:<id>', in that order."""
    named = rows.filter(F.col("id").isNotNull())
    named = named.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    chosen = [r["vector"] for r in named.orderBy("h", "vector").limit(k).collect()]
    return whole_numbers(pa.array(chosen, pa.list_(pa.float64())), dim, scale) if chosen else np.zeros((0, dim), np.int64)


def updated(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: floor of the mean of the rows nearest to each; those without rows stay."""
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast(Centroids.of(centroids))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in _blocks(batches):
            x = whole_numbers(batch.column("vector"), dim, scale)
            number, _, _ = shared.value.nearest(x)
            order = np.argsort(number, kind="stable")
            present, first = np.unique(number[order], return_index=True)
            total[present] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(number, minlength=k)
        held = np.flatnonzero(count)
        columns = [np.repeat(held, dim), np.tile(np.arange(dim), len(held)), total[held].ravel(), np.repeat(count[held], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "component", "total", "n"])

    parts = rows.select("vector").mapInArrow(summed, "cluster long, component long, total long, n long")
    mean = F.expr("sum(total) div sum(n)") - F.when(F.expr("sum(total) % sum(n) < 0"), 1).otherwise(0)
    sums = parts.groupBy("cluster", "component").agg(mean.alias("mean")).collect()  # at most k * dim rows
    following = centroids.copy()
    for r in sums:
        following[r["cluster"], r["component"]] = r["mean"]
    return following


def assigned(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """(id, cluster, distance) of every row; distances are squared."""
    dim = centroids.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(Centroids.of(centroids))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            number, distance, _ = shared.value.nearest(whole_numbers(batch.column("vector"), dim, scale))
            columns = [batch.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    return rows.mapInArrow(search, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def clustered(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every usable vector after ``rounds`` rounds, and the centroids (whole numbers, scaled)."""
    rows = vectors.filter(usable(F.col(vector_column), dim)).select(
        F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    centroids = starts(rows, k, seed, dim, scale)
    if not len(centroids):
        kind = rows.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = updated(rows, centroids, scale)
    return assigned(rows, centroids, scale), centroids


def with_inertia(assignment: DataFrame) -> DataFrame:
    """Adds the sum of distances over the row's cluster and over all; the assignment is computed once, into the shared folder."""
    rows = saved(assignment, "clusters")
    # a row per cluster
    totals = {r["cluster"]: int(r["t"]) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("t")).collect()}
    if not totals:
        return rows.withColumns({"cluster_inertia": F.lit(0).cast("bigint"), "inertia": F.lit(0).cast("bigint")})
    per_cluster = F.create_map(*[F.lit(x) for c, t in totals.items() for x in (c, t)])
    inertia = F.lit(sum(totals.values())).cast("bigint")
    return rows.withColumns({"cluster_inertia": per_cluster[F.col("cluster")].cast("bigint"), "inertia": inertia})
