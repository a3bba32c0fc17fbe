"""Approximate nearest neighbours: a forest of random-projection trees, one queue over all trees, exact distances.

A tree halves the vectors level by level: each level has a direction of its own (a column of a random rotation), and every
node splits at the median of its vectors' projections. Two vectors fall together as long as no split parts them; several
trees with different rotations make it likely that near ones meet somewhere.

A query enters all trees through one priority queue. It always goes on with the node whose cell is nearest, by the squared
distance in the directions seen so far, whichever tree that belongs to, descends to a leaf and leaves the far sides it
passed in the queue, until it has as many leaves as are due to it.

On Spark: the splits are fitted on a bounded sample, of which also the number of leaves per query is learned: sampled
vectors search the sample itself, and the count is taken at which ``recall`` of their true neighbours have been met. The
share of the vectors that this asks for falls as they become more; how fast is measured between a quarter of the sample
and all of it, and carried on to the number of all vectors. Every vector is indexed: it travels once per tree to its leaf, and a
query travels to each of its leaves, where a task measures the distances of the leaf's vectors as they stream by. Equal
vectors are merged before (they would not be parted by any split), so leaves are even whatever repeats, and put apart
again in the result. Vectors without structure, such as random ones, need a large share of all leaves: that is what
their distances are like, and the learned count follows it. ``recall_of`` measures the outcome against all distances.

Defined cases: vectors that are null, zero, of another than the most common length, or hold null, NaN or infinite components
take no part. Rows are what counts: a row is no neighbour of itself, but another with the same id is. Rows without an
id are candidates, last among equally near ones, and never queries. Fewer candidates than wanted are all returned. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import identity, saved, usable

TREES = 4
LEAF_ROWS = 128
# the sample: a share of all vectors within bounds; a leaf holds so many of it at least
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST, SAMPLE_IN_LEAF = 8, 2_048, 1 << 16, 8
# of the sample, what the number of leaves per query is learned on
TRIAL_ROWS, TRIAL_QUERIES = 1 << 13, 128
RECALL = 0.96
# queries and candidates measured against each other at a time
BLOCK = 1_024
# queries whose radius a task remembers; it only spares rows, and starts anew beyond
RADII = 1 << 18


@dataclass
class Forest:
    """Rotations (tree, dimension, level) and split points (tree, node), nodes numbered as in a heap from 1."""

    directions: np.ndarray
    splits: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.directions)

    @property
    def depth(self) -> int:
        return self.directions.shape[2]

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> Forest:
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        directions = np.zeros((trees, dim, depth))
        splits = np.zeros((trees, 1 << depth))
        for t in range(trees):
            # more levels than dimensions take up further rotations
            turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-depth // dim))]
            directions[t] = np.concatenate([np.zeros((dim, 0)), *turns], axis=1)[:, :depth]
            projected = sample @ directions[t]
            node = np.ones(n, np.int64)
            for level in range(depth):
                order = np.lexsort((projected[:, level], node))
                first = np.searchsorted(node[order], np.arange(1 << level, 2 << level))
                ends = np.append(first[1:], n)
                middle = (first + ends) // 2
                values = projected[order, level]
                held = ends > first
                low, high = values[np.maximum(middle - 1, 0)], values[np.minimum(middle, n - 1)]
                splits[t, 1 << level : 2 << level] = np.where(held, (low + high) / 2, 0.0)
                node = 2 * node + (projected[:, level] > splits[t, node])
        return cls(directions, splits)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree, leaves numbered through all trees."""
        out = np.empty((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            projected = vectors @ self.directions[t]
            node = np.ones(len(vectors), np.int64)
            for level in range(self.depth):
                node = 2 * node + (projected[:, level] > self.splits[t, node])
            out[:, t] = node - self.leaves + t * self.leaves
        return out

    def visited(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of all trees, nearest first, from one queue."""
        projected = [(query @ d).tolist() for d in self.directions]
        queue = [(0.0, t, 1, 0) for t in range(self.trees)]
        out: list[int] = []
        while queue and len(out) < most:
            distance, t, node, level = heapq.heappop(queue)
            position, splits = projected[t], self.splits[t]
            while level < self.depth:
                off = position[level] - splits[node]
                node = 2 * node + (off > 0)
                level += 1
                heapq.heappush(queue, (distance + off * off, t, node ^ 1, level))
            out.append(node - self.leaves + t * self.leaves)
        return out


def leaves_due(forest: Forest, sample: np.ndarray, n: int, k: int, recall: float) -> int:
    """How many leaves a query needs among ``n`` vectors, learned by letting sampled vectors search the sample."""
    rows = sample[:TRIAL_ROWS]
    queries = rows[:TRIAL_QUERIES]
    total = forest.trees * forest.leaves
    turn = np.empty((len(queries), total), np.int64)  # of each leaf in the query's order
    for i, q in enumerate(queries):
        turn[i, forest.visited(q, total)] = np.arange(total)

    def needed(among: np.ndarray) -> float:
        """The turn by which ``recall`` of all true neighbours have been met."""
        cells = forest.cells(among)
        met = []
        for i, q in enumerate(queries):
            distance = ((among - q) ** 2).sum(axis=1)
            distance[i] = np.inf
            near = np.argsort(distance, kind="stable")[: min(k, len(among) - 1)]
            met.append(turn[i][cells[near]].min(axis=1))
        return float(np.quantile(np.concatenate(met), recall)) + 1

    if len(rows) <= 4 * max(k, len(queries)):
        return total
    at_quarter, at_all = needed(rows[: len(rows) // 4]), needed(rows)
    slope = min(0.0, max(-1.0, float(np.log(at_all / at_quarter) / np.log(4))))
    return min(total, max(forest.trees, int(np.ceil(at_all * (n / len(rows)) ** slope))))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _with_cells(rows: DataFrame, forest: Forest, most: int | None) -> DataFrame:
    """A row per leaf: of every tree, or (``most``) of those that the row's vector visits as a query."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)
    dim = forest.directions.shape[1]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("vector"), dim)
            found = known.cells(vectors) if most is None else np.array([known.visited(v, most) for v in vectors], np.int64)
            width = known.trees if most is None else min(most, known.trees * known.leaves)
            offsets = pa.array(np.arange(len(vectors) + 1) * width, pa.int32())
            column = pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(cells, f"{fields}, cells array<bigint>")
    return found.withColumn("cell", F.explode("cells")).drop("cells")


def _measured(dealt: DataFrame, dim: int, k: int) -> DataFrame:
    """(q1, q2, score, c1, c2, ids) of each query's nearest vectors in every leaf; rows come by leaf, queries first."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, queries, names = None, np.zeros((0, dim)), []
        radius: dict[tuple[int, int], float] = {}  # within which a query has met k vectors already
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("vector"), dim)
            keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist()))
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), len(cell)]):
                if cell[start] != here:
                    here, queries, names = cell[start], np.zeros((0, dim)), []
                    if len(radius) > RADII:
                        radius.clear()
                if asks[start]:
                    queries, names = np.concatenate([queries, vectors[start:end]]), [*names, *keys[start:end]]
                    continue
                for q in range(0, len(names), BLOCK):
                    for c in range(start, end, BLOCK):
                        some, stop = names[q : q + BLOCK], min(end, c + BLOCK)
                        pairs = _nearest(queries[q : q + BLOCK], some, vectors[c:stop], k, radius)
                        if len(pairs[0]):
                            asked = [some[i] for i in pairs[0]]
                            at = pa.array(pairs[1] + c)
                            columns = [pa.array([x[0] for x in asked], pa.int64()), pa.array([x[1] for x in asked], pa.int64())]
                            columns += [pa.array(pairs[2]), *[batch.column(x).take(at) for x in ("h1", "h2", "ids")]]
                            yield pa.RecordBatch.from_arrays(columns, ["q1", "q2", "score", "c1", "c2", "ids"])

    kind = dealt.schema["ids"].dataType.simpleString()
    return dealt.mapInArrow(measure, f"q1 long, q2 long, score double, c1 long, c2 long, ids {kind}")


def _nearest(queries, names, vectors, k, radius) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector, distance) with at least the k nearest of each query, but none beyond its radius so far."""
    q2, v2 = (queries**2).sum(axis=1), (vectors**2).sum(axis=1)
    rough = q2[:, None] + v2[None, :] - 2.0 * (queries @ vectors.T)
    bound = np.array([radius.get(name, np.inf) for name in names])
    if len(vectors) >= k:
        bound = np.minimum(bound, np.partition(rough, k - 1, axis=1)[:, k - 1])
        radius.update(zip(names, bound.tolist()))
    # the rough distances are only good for what is surely too far
    slack = 1e-12 * queries.shape[1] * (q2 + v2.max())
    i, j = np.nonzero(rough <= (bound + slack)[:, None])
    return i, j, np.sqrt(((queries[i] - vectors[j]) ** 2).sum(axis=1))


def merged(rows: DataFrame, copies: int) -> DataFrame:
    """(h1, h2, vector, ids): every distinct vector once, with its smallest ids, at most ``copies`` (repeats included).

    The limit runs within each task before the shuffle, so a vector that a third of all rows repeat sends ``copies`` a task.
    """
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("id").asc_nulls_last()))
    few = rows.withColumn("place", place).filter(F.col("place") <= copies)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return few.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector"), ids.alias("ids"))


def search(
    table: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 10,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for every row that ``is_query`` (a condition on ``id``)."""
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    common = rows.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).count()
    widest = common.orderBy(F.desc("count"), F.desc("n")).first()
    dim = widest["n"] if widest else 1
    h1, h2 = identity(F.col("vector"))
    some = F.exists("vector", lambda x: x != 0)
    rows = rows.filter(usable(F.col("vector"), dim)).filter(some).withColumns({"h1": h1, "h2": h2})
    asking = rows.filter(F.col("id").isNotNull() & is_query)

    # a query's own vector may be among the nearest without counting: one more of each is looked for
    vectors = saved(merged(rows, k + 1), "vectors")
    n = vectors.count()
    forest, due = _fitted(vectors, n, dim, k + 1, trees, recall)

    queries = asking.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector"))
    ids = F.lit(None).cast(vectors.schema["ids"].dataType).alias("ids")
    sides = [
        _with_cells(queries.select("h1", "h2", "vector", ids), forest, due).withColumn("asks", F.lit(True)),
        _with_cells(vectors.select("h1", "h2", "vector", "ids"), forest, None).withColumn("asks", F.lit(False)),
    ]
    dealt = sides[0].unionAll(sides[1]).repartition("cell").sortWithinPartitions("cell", F.desc("asks"))
    found = _measured(dealt, dim, k + 1)

    # a vector met in several trees comes with the same distance each time
    smallest = F.array_min("ids")
    hit = F.struct("score", smallest.isNull().alias("unnamed"), smallest.alias("smallest"), "c1", "c2", "ids")
    hits = F.slice(F.sort_array(F.collect_set(hit)), 1, k + 1)
    nearest = found.groupBy("q1", "q2").agg(hits.alias("hits"))

    def row(score: Column, vec_id: Column) -> Column:
        return F.struct(score.alias("score"), vec_id.isNull().alias("unnamed"), vec_id.alias("vec_id"))

    rows_of = F.transform("hits", lambda h: F.transform(h["ids"], lambda i: row(h["score"], i)))
    nearest = nearest.select("q1", "q2", F.sort_array(F.flatten(rows_of)).alias("hits"))

    asked = asking.select("id", "h1", "h2").join(nearest, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2")))
    own = F.array_position("hits", row(F.lit(0.0), F.col("id")))
    others = F.filter("hits", lambda h, i: i + 1 != F.col("own"))
    best = asked.withColumn("own", own).select("id", F.posexplode(F.slice(others, 1, k)).alias("place", "hit"))
    return best.select(
        F.col("id").alias("query_id"), (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), "hit.score"
    )


def _fitted(vectors: DataFrame, n: int, dim: int, k: int, trees: int, recall: float) -> tuple[Forest, int]:
    """The forest, fitted on a sample by hash, and the number of leaves a query visits."""
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, n // SAMPLE_SHARE))
    chosen = vectors.select("h1", "h2", "vector").orderBy("h1", "h2").limit(size).toArrow()
    sample = _matrix(chosen.column("vector").combine_chunks(), dim) if len(chosen) else np.zeros((0, dim))
    depth = 0
    while (n >> depth) > LEAF_ROWS and (len(sample) >> depth) >= 2 * SAMPLE_IN_LEAF:
        depth += 1
    forest = Forest.fit(sample, trees, depth)
    return forest, leaves_due(forest, sample, n, k, recall)


def recall_of(found: DataFrame, table: DataFrame, n_queries: int = 100, k: int = 10) -> float:
    """The share of true neighbours among those found, for some (by hash) of the queries, by measuring all distances.

    ``found`` as ``search`` gives it, ``table``: (id, vector), usable vectors only. The queries, a bounded number,
    are sent to all rows. A found row counts if it is no farther than the true k-th nearest.
    """
    ids = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(n_queries)
    asked = table.join(F.broadcast(ids), F.col("id") == F.col("query_id")).select("id", "vector").collect()
    names, queries = [r["id"] for r in asked], np.array([r["vector"] for r in asked], np.float64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), k), np.inf)
        for batch in batches:
            vectors, own = _matrix(batch.column("vector"), queries.shape[1]), batch.column("id").to_pylist()
            for i, q in enumerate(queries):
                distance = np.sqrt(((vectors - q) ** 2).sum(axis=1))
                distance[[j for j, x in enumerate(own) if x == names[i]]] = np.inf
                best[i] = np.sort(np.concatenate([best[i], distance]))[:k]
        columns = [np.repeat(names, k), best.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1])], ["query_id", "distance"])

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance"))
    true = table.select("id", "vector").mapInArrow(measure, "query_id long, distance double")
    true = true.filter(F.col("distance") < float("inf")).withColumn("place", place).filter(F.col("place") <= k)
    limit = true.groupBy("query_id").agg(F.max("distance").alias("limit"), F.count(F.lit(1)).alias("n"))
    good = found.join(F.broadcast(limit), "query_id").filter(F.col("score") <= F.col("limit") * (1 + 1e-12)).count()
    return good / max(1, limit.agg(F.sum("n")).first()[0] or 0)
