"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words. Its documents are taken ``target / size of the source`` times: a whole number
of copies that all of them get, and one fractional copy. Fractions are made whole in pairs: a document and all shorter ones
together hand words to each other, in a random direction whose odds keep all expectations, until one document is taken or
left. What one side gives the other gets, so a source's words never change; at the end one document of a source has a
fraction left, mostly a short one, and only that one is rounded. Only where all shorter documents together are too short to
make up for a long one, the long one is what is rounded. Chunks of documents are reduced in parallel; the one that each leaves open meets those of other chunks in
the next level of a reduction tree, until one is left per source. Nothing but document ids, sources and sizes is moved.

Draws depend on the values only: a rerun gives the same mix. Rows that agree in id, source and size are counted first and
reduced as one: whole copies are dealt to them, and one fraction is left to the tree.

Defined cases: a null text has size 0 and is taken 0 times in words (it is kept as often as the whole copies say); a null
source is a source of its own, last in order; a source of size 0 has target 0; documents of equal size are paired in an order
drawn from the hash of their values; an empty table gives an empty result; extra columns of ``mix`` are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.llm.common import WORD, fresh, identity, join_grouped, repeated, saved, uniform

CHUNK = 4_096
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size) with ``target``: shares of all words by weight, none above ``most`` times its source.

    Sources take the weights in turn, by code point, null last. What capped sources cannot use goes to the others by
    weight until none is above: with sources ordered by cap / weight, the capped ones come first.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)
    rows = sizes.withColumns({"_weight": weight, "_cap": (F.col("source_size") * most).cast("double")})
    by = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    left = total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = left / F.sum("_weight").over(after)
    # from the first source whose cap is above the level, all share at that source's level
    rows = rows.withColumn("_open", F.when(F.col("_cap") > level * F.col("_weight"), level))
    first = F.first("_open", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    share = F.coalesce(first * F.col("_weight"), F.col("_cap"))
    return rows.withColumn("target", F.least(share, F.col("_cap"))).drop("_weight", "_cap", "_open")


def _reduce(rows: pa.Table) -> pa.Table:
    """Makes the fractions of one chunk whole, the longest document's first; at most one, mostly a short one, stays open.

    The longest open document's partner are all shorter open ones together: words go from it to them or from them to it, in
    a random direction, until it is taken or left, or one of them is. Every one of the others gains or loses the same
    fraction, so a long document's rounding is made up for by many short ones.
    """
    part, size, coin = (rows[c].to_numpy().astype(np.float64) for c in ("part", "size", "coin"))
    order = np.lexsort((rows["unit"].to_numpy(), rows["draw"].to_numpy(), -size))
    order = order[(part[order] > 0.0) & (part[order] < 1.0)]
    coins = iter(coin[order])
    # the documents still open: fractions and sizes, longest first
    f, s = part[order], size[order]
    while len(f) > 1:
        others = s[1:].sum()
        up = min((1.0 - f[0]) * s[0], others * f[1:].min())  # words that the first can get from the others
        down = min(f[0] * s[0], others * (1.0 - f[1:].max()))  # words that they can get from it
        gained = up if next(coins) * (up + down) < down else -down
        f[0] += gained / s[0]
        f[1:] -= gained / others
        f[np.abs(f) < 1e-9] = 0.0
        f[np.abs(f - 1.0) < 1e-9] = 1.0
        closed = (f == 0.0) | (f == 1.0)
        part[order[closed]] = f[closed]
        order, f, s = order[~closed], f[~closed], s[~closed]
    part[order] = f
    at = rows.schema.get_field_index("part")
    return rows.set_column(at, rows.schema.field(at), pa.array(part, pa.float64()))


def plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, rows, base, extra) per distinct (doc_id, source, size).

    Of its ``rows`` equal rows, ``extra`` are taken ``base + 1`` times and the others ``base`` times.
    """
    light = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    sources = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = saved(targets(sources, weights, most), "targets").withColumnRenamed("source", "_source")
    units = light.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = join_grouped(units, sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(times, F.lit(float(most)))
    units = units.withColumn("base", F.floor(copies).cast("bigint"))
    extra = F.when(F.col("size") > 0, F.col("rows") * (copies - F.col("base"))).otherwise(0.0)
    units = units.withColumn("_extra", extra)
    unit = F.xxhash64(F.lit("unit"), "doc_id", "source", "size")
    chunks = F.ceil(F.col("_rows") / CHUNK).cast("bigint")
    units = units.withColumns(
        {
            "whole": F.floor("_extra").cast("bigint"),
            "part": F.col("_extra") - F.floor("_extra"),
            "unit": unit,
            "chunk": F.pmod(F.xxhash64(F.lit("chunk"), unit), chunks),
            "left": chunks,
        }
    )
    done, open_units, level = None, units.drop("_extra", "_rows"), 0
    while True:
        drawn = open_units.withColumns(
            {"draw": uniform(F.lit(f"draw{level}"), "unit"), "coin": uniform(F.lit(f"coin{level}"), "unit")}
        )
        reduced = drawn.groupBy("source", "chunk").applyInArrow(_reduce, drawn.schema)
        reduced = saved(reduced, f"level{level}")
        is_open = (F.col("part") > 0) & (F.col("part") < 1)
        # where one chunk was left, its last fraction is rounded
        last = F.when(is_open & (F.col("left") == 1), (F.col("coin") < F.col("part")).cast("double"))
        reduced = reduced.withColumn("part", F.coalesce(last, F.col("part")))
        closed = reduced.filter(~is_open).drop("draw", "coin")
        done = closed if done is None else done.unionByName(closed)
        open_units = reduced.filter(is_open).drop("draw", "coin")
        if open_units.isEmpty():
            break
        fewer = F.ceil(F.col("left") / CHUNK).cast("bigint")
        open_units = open_units.withColumns({"chunk": F.pmod(F.col("chunk"), fewer), "left": fewer})
        level += 1
    extra = (F.col("whole") + F.round("part")).cast("bigint").alias("extra")
    return done.select("doc_id", "source", "size", "source_size", "target", "rows", "base", extra)


def per_row(planned: DataFrame) -> DataFrame:
    """One row per document row, with ``copies`` and ``taken`` words."""
    (number,) = fresh(planned, "number")
    rows = repeated(planned, "rows", number)
    copies = F.col("base") + (F.col(number) < F.col("extra")).cast("bigint")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(number)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The documents, each as often as the mix takes it, with all their columns."""
    names = docs.columns
    planned = saved(plan(docs, weights, most).filter("base + extra > 0"), "plan")
    unit = identity(F.col("doc_id"), F.col("source"), F.col("size"))
    planned = planned.select(*[h.alias(f"_mix{i}") for i, h in enumerate(unit)], "base", "extra")
    planned = planned.toDF("_mix0", "_mix1", "_base", "_extra")
    inner = [f"_doc{i}" for i in range(len(names))]
    doc_id, source, text = (F.col(inner[names.index(c)]) for c in ("doc_id", "source", "text"))
    unit = identity(doc_id, source, n_words(text))
    rows = docs.toDF(*inner).withColumns({f"_key{i}": h for i, h in enumerate(unit)})
    rows = rows.join(planned, (F.col("_key0") == F.col("_mix0")) & (F.col("_key1") == F.col("_mix1")))
    # equal rows are told apart by their number; the join has brought them together already
    number = F.row_number().over(Window.partitionBy("_key0", "_key1").orderBy("_key0"))
    rows = rows.withColumn("_copies", F.col("_base") + (number <= F.col("_extra")).cast("bigint")).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).select(*inner).toDF(*names)
