"""Shards of near equal size by sampled splitters.

Rows have an ordered key and a size. A size-weighted sample of keys gives quantile boundaries; they cut the key range into
many more ranges than shards, of about equal bytes. Ranges that turn out overfull are subdivided by further samples of
their own rows. Every range then is one task's work: running sums within it, on top of the sums of the ranges before it,
place every row exactly. Rows with the same first key column (a group, such as equal texts) stay in one shard unless the
group is larger than ``whole_share`` of a shard. Only Spark's own functions are used; the driver sees the boundaries and the sums
of the ranges, whose number is a parameter.

Defined cases: null keys come first; a null size counts as 0; rows that are equal in every column get places of their own, split like others; a
row larger than a shard's share makes its shard larger; sizes that are all zero put everything into shard 0; an empty
table gives an empty result; extra columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DataType

from tillroll.llm.common import fresh, saved, uniform

# sampled keys per range: a range's bytes then stay within about a third of the mean
SAMPLES_PER_RANGE = 32
SPLIT_ROUNDS = 4


def _literal(values: Sequence, kind: DataType) -> Column:
    fields = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, kind.fields)]
    return F.struct(*fields)


def _range_of(key: Column, splitters: list, kind: DataType) -> Column:
    """Number of splitters at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    borders = F.array(*[_literal(s, kind) for s in splitters])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(borders, at + step - 1) <= key, at + step).otherwise(at),
    )


def _quantiles(sample: list, parts: int) -> list:
    """Up to ``parts - 1`` different boundaries that cut the ordered sample into equal parts."""
    cuts = dict.fromkeys(tuple(sample[len(sample) * i // parts]) for i in range(1, parts)) if sample else {}
    return list(cuts)


def assign_shards(
    rows: DataFrame,
    key: Sequence[Column],
    size: Column,
    n_shards: int,
    whole_share: float = 0.01,
    ranges: int | None = None,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 within the shard).

    ``key`` are orderable columns, the first of which names the group. ``ranges``: by default as many as the session has
    shuffle partitions, at least four per shard.
    """
    spark = rows.sparkSession
    ranges = ranges or max(4 * n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = list(rows.columns)
    inner = [f"_row{i}" for i in range(len(names))]
    k, s, r = "_key", "_size", "_range"
    # the tie tells equal rows apart; it is fixed by writing the rows before anything depends on it
    tie = F.xxhash64(F.monotonically_increasing_id())
    parts = [c.alias(f"k{i}") for i, c in enumerate([*key, tie])]
    keyed = rows.withColumns(dict(zip(fresh(rows, k, s), (F.struct(*parts), F.coalesce(size, F.lit(0)).cast("bigint")))))
    keyed = saved(keyed.toDF(*inner, k, s), "keyed")
    kind = keyed.schema[k].dataType

    def sample(of: DataFrame, n: int) -> list:
        """The n smallest of exponential variables with the sizes as rates: a sample weighted by size, in key order."""
        chance = -F.log(uniform(F.lit("sample"), F.col(k))) / F.greatest(F.col(s), F.lit(1))
        drawn = of.select(k, chance.alias("_chance")).orderBy("_chance").limit(n)
        return [row[0] for row in drawn.select(k).orderBy(k).collect()]

    splitters = _quantiles(sample(keyed, SAMPLES_PER_RANGE * ranges), ranges)
    for _ in range(SPLIT_ROUNDS):
        ranged = keyed.withColumn(r, _range_of(F.col(k), splitters, kind))
        sums = ranged.groupBy(r).agg(F.sum(s).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(k).alias("first"))
        sums = sorted(sums.collect(), key=lambda x: x[r])
        fair = max(1, sum(x["bytes"] for x in sums) / ranges)
        overfull = {x[r]: x for x in sums if x["bytes"] > 2 * fair and x["rows"] > 1}
        more = _finer(ranged.filter(F.col(r).isin(*overfull)), overfull, fair, splitters, sample) if overfull else []
        if not more:
            break
        borders = F.array(*[_literal(cut, kind) for cut in [*splitters, *more]])
        ordered = spark.range(1).select(F.explode(F.array_sort(F.array_distinct(borders))).alias(k))
        splitters = [tuple(row[0]) for row in ordered.collect()]
    else:
        ranged = keyed.withColumn(r, _range_of(F.col(k), splitters, kind))
        sums = ranged.groupBy(r).agg(F.sum(s).alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()

    by_range = {x[r]: x for x in sums}
    before, at, n = {}, 0, 0
    for i in sorted(by_range):
        before[i] = (at, n)
        at, n = at + by_range[i]["bytes"], n + by_range[i]["rows"]
    placed = [before.get(i, (0, 0)) for i in range(len(splitters) + 1)]
    bytes_before = F.get(F.array(*[F.lit(x[0]).cast("bigint") for x in placed]), F.col(r))
    rows_before = F.get(F.array(*[F.lit(x[1]).cast("bigint") for x in placed]), F.col(r))

    running = Window.partitionBy(r).orderBy(k).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(r, f"{k}.k0")
    placed_rows = ranged.withColumns(
        {"_end": F.sum(s).over(running), "_at": rows_before + F.row_number().over(Window.partitionBy(r).orderBy(k)) - 1}
    ).withColumns({"_group": F.sum(s).over(group), "_start": F.min(F.col("_end") - F.col(s)).over(group)})
    small = F.col("_group") <= whole_share * at / n_shards
    middle = F.when(small, F.col("_start") + F.col("_group") / 2).otherwise(F.col("_end") - F.col(s) / 2)
    shard = F.floor((bytes_before + middle) * n_shards / F.lit(float(max(at, 1))))
    placed_rows = placed_rows.withColumn("_shard", F.least(shard, F.lit(n_shards - 1)).cast("int"))
    firsts = placed_rows.groupBy(F.col("_shard").alias("_of")).agg(F.min("_at").alias("_first"))  # n_shards rows
    out = placed_rows.join(F.broadcast(firsts), F.col("_shard") == F.col("_of"))
    kept = [i for i, c in enumerate(names) if c.lower() not in ("shard", "slot")]
    out = out.select(*[inner[i] for i in kept], "_shard", (F.col("_at") - F.col("_first")).alias("_slot"))
    return out.toDF(*[names[i] for i in kept], "shard", "slot")


def _finer(rows: DataFrame, overfull: dict, fair: float, splitters: list, sample) -> list:
    """New boundaries within the overfull ranges, from a sample of their rows."""
    wanted = sum(int(x["bytes"] // fair) + 1 for x in overfull.values())
    drawn = sample(rows, SAMPLES_PER_RANGE * wanted)
    known = {tuple(s) for s in splitters} | {tuple(x["first"]) for x in overfull.values()}
    return [cut for cut in _quantiles(drawn, wanted) if cut not in known]
