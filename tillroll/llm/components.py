"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import join_uneven, saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for links (a, b) of orderable nodes; root is the smallest node reachable.

    Alternates two steps until nothing changes: every node hands its larger neighbours to the smallest one it knows, then
    hands its smaller neighbours to the smallest of them; paths shrink by half or more in each round. Both are joins with
    grouped minima. In the end a component is a star, so a node with very many links is the rule: its minimum is sent to its
    links instead of its links to one task.

    Defined cases: links of a node to itself and repeated links count for nothing, links may be given in either direction; a
    node without links to others is not in the result; without links the result is empty.
    """
    edges = _directed(links, "links")
    state = _checksum(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both, F.col("v") > F.col("u"))
        smaller = _to_smallest(_oriented(large), F.lit(True))
        following = _directed(smaller.select(F.col("u").alias("a"), F.col("v").alias("b")), "round")
        before, state = state, _checksum(following)
        if state == before:
            roots = following.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return following.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
        edges = following


def _checksum(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 31)))).first())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()


def _directed(links: DataFrame, name: str) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return saved(_oriented(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), name)


def _to_smallest(edges: DataFrame, which) -> DataFrame:
    """Links from the neighbours v of every node u (those ``which`` holds for), and from u, to the smallest of both."""
    smallest = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n"))
    smallest = saved(smallest.select(F.col("u").alias("_u"), "m", "_n"), "smallest")
    moved = join_uneven(edges.filter(which), smallest, "u", "_u", "_n").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(smallest.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter("u != v")
