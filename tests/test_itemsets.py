"""Frequent sets against all sets of all orders."""

import collections
import itertools
import random

import pytest

from sample import line, sales
from tillroll.operators import itemsets


def baskets_of(seed, n):
    rng = random.Random(seed)
    common = [f"1000{i}" for i in range(4)]
    found = {}
    for i in range(n):
        items = {c for c in common if rng.random() < 0.4} | {f"2{rng.randrange(200):04}" for _ in range(rng.randrange(6))}
        found[str(i)] = items | ({"POST"} if rng.random() < 0.5 else set())
    return found


def brute(baskets, least, size, keep):
    counts = collections.Counter()
    for items in baskets.values():
        kept = sorted(filter(keep, items))
        for k in range(2, size + 1):
            counts.update(itertools.combinations(kept, k))
    return {items: n for items, n in counts.items() if n >= least}


@pytest.mark.parametrize("chunk, candidates", [(20_000, 100_000), (25, 3)])
@pytest.mark.parametrize("size", [2, 3, 4])
def test_frequent_sets(spark, monkeypatch, chunk, candidates, size):
    """One chunk or many, all candidates at once or a few at a time: the same sets."""
    monkeypatch.setattr(itemsets, "CHUNK", chunk)
    monkeypatch.setattr(itemsets, "CANDIDATES", candidates)
    baskets = baskets_of(size, 300)
    lines = [line(invoice=o, code=c) for o, items in baskets.items() for c in items]
    lines += lines[:40] + [line(invoice=None, code="10000"), line(invoice="0", code=None)]
    orders = len([items for items in baskets.values() if items])
    got = itemsets.frequent_itemsets(sales(spark, lines).repartition(5), 12 / orders, size).collect()
    expected = brute(baskets, 12, size, lambda c: c != "POST")
    assert {tuple(r["items"]): r["orders"] for r in got} == expected
    assert all(r["size"] == len(r["items"]) <= size for r in got)
    assert [r["orders"] for r in got] == sorted((r["orders"] for r in got), reverse=True)


def test_large_orders_are_not_cut(spark):
    """An order of 600 products, of which no two occur together often, costs no pairs."""
    lines = [line(invoice="big", code=f"3{i:04}") for i in range(600)]
    lines += [line(invoice=str(i), code=c) for i in range(20) for c in ("30001", "30007")]
    got = itemsets.frequent_itemsets(sales(spark, lines), 0.5).collect()
    assert [(r["items"], r["orders"]) for r in got] == [(["30001", "30007"], 21)]


def test_nothing_to_mine(spark):
    assert itemsets.frequent_itemsets(sales(spark, [])).collect() == []
    assert itemsets.frequent_itemsets(sales(spark, [line(), line(invoice="2")]), 0.1).collect() == []
