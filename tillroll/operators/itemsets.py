"""Frequent itemsets: all sets of products that occur together in enough orders, exactly, in two passes.

What is frequent among all orders is frequent in at least one part of them, measured by the same share. The first pass
therefore mines every chunk of orders by itself and collects the sets that are frequent there; the second counts just these
candidates over all orders, which settles the matter. Neither pass forms pairs of what is not frequent somewhere, so the
number of products hardly matters, and no order is cut to a size.

In a chunk every product has a bit set, one bit per order; a set of products is counted by and-ing bit sets, and extended as
long as it stays frequent. Memory is bounded by the chunk. A support that amounts to a single order of a chunk makes every set
of its orders a candidate: ask for no less than a few orders in ``CHUNK``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.functions.bands import PRODUCT_PATTERN, is_product
from tillroll.functions.metrics import occurring
from tillroll.functions.numbers import percent, rounded

# orders in a chunk, and candidates that are counted (and broadcast) at a time
CHUNK = 20_000
CANDIDATES = 100_000


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[str]]]:
    chunk: list[list[str]] = []
    for batch in batches:
        for basket in batch.column("items").to_pylist():
            chunk.append(basket)
            if len(chunk) == CHUNK:
                yield chunk
                chunk = []
    if chunk:
        yield chunk


def _bit_sets(chunk: list[list[str]]) -> dict[str, int]:
    places: dict[str, list[int]] = {}
    for i, basket in enumerate(chunk):
        for item in basket:
            places.setdefault(item, []).append(i)
    sets = {}
    for item, held in places.items():
        flags = bytearray(len(chunk) // 8 + 1)
        for i in held:
            flags[i >> 3] |= 1 << (i & 7)
        sets[item] = int.from_bytes(flags, "little")
    return sets


def mined(chunk: list[list[str]], least: int, max_size: int) -> Iterator[tuple[str, ...]]:
    """All sets of two to ``max_size`` items that at least ``least`` baskets of the chunk hold, items in order."""
    frequent = sorted((item, bits) for item, bits in _bit_sets(chunk).items() if bits.bit_count() >= least)
    # sets still to be extended, each with the items that may follow its last one
    todo = [((item,), bits, frequent[i + 1 :]) for i, (item, bits) in enumerate(frequent)]
    while todo:
        items, bits, later = todo.pop()
        joined = [(item, both) for item, other in later if (both := bits & other).bit_count() >= least]
        for i, (item, both) in enumerate(joined):
            found = (*items, item)
            yield found
            if len(found) < max_size:
                todo.append((found, both, joined[i + 1 :]))


def frequent_itemsets(
    s: DataFrame, min_support: float = 0.01, max_size: int = 3, pattern: str | None = PRODUCT_PATTERN
) -> DataFrame:
    """(items, size, orders, support_pct): sets of two to ``max_size`` products that at least ``min_support`` of all orders
    hold together, most frequent first. Lines without an order number belong to none.

    Only products frequent by themselves take part, which keeps what a task holds of an order short. The candidates, found by the
    first pass when this is called, are counted ``CANDIDATES`` at a time.
    """
    held = occurring(s.where(F.col("InvoiceNo").isNotNull()), ["InvoiceNo", "StockCode"])
    n_orders = held.agg(F.count_distinct("InvoiceNo")).first()[0]
    least = max(1, math.ceil(min_support * n_orders - 1e-9))
    product = F.col("StockCode").isNotNull() if pattern is None else is_product(F.col("StockCode"), pattern)
    alone = held.where(product).groupBy("StockCode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    baskets = held.join(alone.select("StockCode"), "StockCode").groupBy("InvoiceNo")
    baskets = baskets.agg(F.sort_array(F.collect_list("StockCode")).alias("items")).where(F.size("items") > 1).select("items")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, ...]] = set()
        for chunk in _chunks(batches):
            # the same share of the chunk; orders with fewer than two such products count as orders, but hold no set
            local = max(1, math.ceil(least * len(chunk) / max(n_orders, 1) - 1e-9))
            new = [x for x in mined(chunk, local, max_size) if x not in seen]
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(list, new)), pa.list_(pa.string()))], ["items"])

    candidates = baskets.mapInArrow(mine, "items array<string>").distinct().orderBy("items")
    blocks: list[DataFrame] = []
    pending: list[tuple[str, ...]] = []
    for row in candidates.toLocalIterator():
        pending.append(tuple(row["items"]))
        if len(pending) == CANDIDATES:
            blocks.append(_counted(baskets, pending))
            pending = []
    if pending or not blocks:
        blocks.append(_counted(baskets, pending))
    counted = blocks[0]
    for block in blocks[1:]:
        counted = counted.unionAll(block)
    return (
        counted.where(F.col("orders") >= least)
        .select("items", F.size("items").alias("size"), "orders", rounded(percent(F.col("orders"), F.lit(n_orders))).alias("support_pct"))
        .orderBy(F.desc("orders"), "items")
    )


def _counted(baskets: DataFrame, candidates: list[tuple[str, ...]]) -> DataFrame:
    """How many baskets hold each candidate."""
    shared = baskets.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * len(shared.value)
        for chunk in _chunks(batches):
            sets = _bit_sets(chunk)
            for i, items in enumerate(shared.value):
                bits = sets.get(items[0], 0)
                for item in items[1:]:
                    bits &= sets.get(item, 0)
                totals[i] += bits.bit_count()
        found = [(i, n) for i, n in enumerate(totals) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(shared.value[i]) for i, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.int64())],
            ["items", "n"],
        )

    parts = baskets.mapInArrow(count, "items array<string>, n long")
    return parts.groupBy("items").agg(F.sum("n").alias("orders"))
