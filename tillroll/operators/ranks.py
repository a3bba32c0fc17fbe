"""Exact ranks, order statistics and running totals without sorting everything in one task.

A plain ``Window.orderBy`` without partitions moves all rows to one task. The operators here go by counting instead: a
histogram over an order-preserving, coarse form of the value (its leading digits) is small whatever the size of the
data, tells in which bucket a wanted rank lies, and only the rows of that bucket are looked at again. All steps are
partial aggregations, so ties and hot values cost nothing, and nothing depends on how rows happen to be partitioned: a
recomputed task gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

LEADING_DIGITS = 4
# rows looked at to part an order, and parts
SAMPLE, SPLITTERS = 4096, 511
# Stand for NULL in an order key: below every real key where NULLs sort first, above where they sort last.
LOWEST = -(9 * 10**18)
HIGHEST = Decimal(10**37)


def leading_digits(x: Column, digits: int = LEADING_DIGITS) -> Column:
    """Order-preserving bucket of a whole number: its length and its first digits, e.g. 1234567 -> 71234.

    At most 9 * 10**(digits-1) buckets per power of ten, so at most some 170,000 per sign for 4 digits of a BIGINT, twice
    as many of a DECIMAL(38,0).
    """
    text = F.abs(x).cast("string")
    size = F.length(text) * F.lit(10**digits) + F.substring(text, 1, digits).cast("int")
    return F.when(x < 0, -size).otherwise(size)


def sort_key(x: Column) -> Column:
    """An order key in which NULL comes first; numbers of 19 digits and more must not be NULL."""
    return F.coalesce(x, F.lit(LOWEST))


def descending(x: Column) -> Column:
    """A DECIMAL(38,0) order key, largest value first and NULL last."""
    return F.coalesce(-x.cast("decimal(38,0)"), F.lit(HIGHEST).cast("decimal(38,0)"))


def rows_at_ranks(
    df: DataFrame,
    order: Sequence[str],
    targets: Mapping[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
    merge_equal: bool = False,
    finer_last: bool = False,
) -> DataFrame:
    """The rows at given 1-based ranks, per group ``by``: columns ``by``, ``target``, ``order``.

    ``order`` lists non-null columns of whole numbers, most significant first. ``targets`` names each wanted rank and computes it
    from n, the row count of its group. The first pass over ``df`` counts by the leading digits of the first column;
    each further pass looks only at the bucket found, counts it by the exact value of one column and the leading digits
    of the next, and so closes in on the row. Between passes only the targets (a handful of rows) are broadcast.

    ``merge_equal`` first merges rows with equal keys. That shuffles the distinct keys once, and every pass then reads
    them from there: right for aggregated input (orders, customers), which would else be aggregated again in each pass.
    Lines are better scanned again, as only the one column is read and nothing is shuffled.

    ``finer_last`` adds a pass over twice as many digits of the last column. It is meant for identifiers, which often
    share their first digits: without it, one bucket could hold them all.
    """
    if merge_equal:
        df = df.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.sum("_n") if merge_equal else F.count(F.lit(1))
    leads = [f"_lead{i}" for i in range(len(order))]
    df = df.withColumns({lead: leading_digits(F.col(name)) for lead, name in zip(leads, order)})
    steps = [[name, *leads[i + 1 : i + 2]] for i, name in enumerate(order)]
    if finer_last:
        df = df.withColumn("_finer", leading_digits(F.col(order[-1]), 2 * LEADING_DIGITS))
        steps.insert(-1, ["_finer"])

    in_order = Window.partitionBy(*by).orderBy(leads[0])
    wanted = F.array(
        *[F.struct(F.lit(t).alias("target"), rank(F.col("n")).cast("bigint").alias("rank")) for t, rank in targets.items()]
    )
    counted = (
        df.groupBy(*by, leads[0])
        .agg(rows.alias("cnt"))
        .withColumns({"upto": F.sum("cnt").over(in_order), "n": F.sum("cnt").over(Window.partitionBy(*by))})
        .select(*by, leads[0], "cnt", "upto", F.inline(wanted))
    )
    known = [*by, leads[0]]
    found = _holding_rank(counted, [*known, "target"])

    for step in steps:
        in_order = Window.partitionBy(*by, "target").orderBy(*step)
        counted = (
            df.join(F.broadcast(found), known)
            .groupBy(*known, "target", "rank", *step)
            .agg(rows.alias("cnt"))
            .withColumn("upto", F.sum("cnt").over(in_order))
        )
        known += step
        found = _holding_rank(counted, [*known, "target"])
    return found.select(*by, "target", *order)


def _holding_rank(counted: DataFrame, keep: list[str]) -> DataFrame:
    before = F.col("upto") - F.col("cnt")
    return counted.where((before < F.col("rank")) & (F.col("rank") <= F.col("upto"))).select(
        *keep, (F.col("rank") - before).alias("rank")
    )


def ntile_ends(n_tiles: int) -> dict[str, Callable[[Column], Column]]:
    """Rank of the last row of every tile but the last; the first n % n_tiles tiles hold one row more."""

    def end(tile: int) -> Callable[[Column], Column]:
        return lambda n: F.floor(n / n_tiles) * tile + F.least(F.lit(tile), n % n_tiles)

    return {str(tile): end(tile) for tile in range(1, n_tiles)}


def with_ntiles(df: DataFrame, n_tiles: int, orders: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Add NTILE columns over the whole frame: ``orders`` maps each new column to its order (whole numbers, ascending).

    NTILE only needs the row that ends each tile; the tile of a row is then the number of ends before it, a comparison
    within the row's own task. The ends of all orders are found together in two passes over ``df``. A sample of bounded
    size gives splitters, whole keys at even distances; the first pass counts the rows between any two of them, which
    tells exactly between which two an end lies and at which place there. The second pass sorts only those rows, one
    N / ``SPLITTERS`` th of all for each end. Each order must end in a column that makes its keys unique: then equal values of the
    columns before it do not gather anywhere. The sample decides how even the parts are, never the result.
    """
    width = max(len(cols) for cols in orders.values())
    slots = [f"_k{i}" for i in range(width)]

    def key(cols: Sequence[Column]) -> list[Column]:
        # shorter orders start with a constant, so that the last columns, the identifiers, fall together
        padded = [*[F.lit(0).cast("bigint")] * (width - len(cols)), *map(sort_key, cols)]
        return [c.alias(slot) for c, slot in zip(padded, slots)]

    keys = F.array(*[F.struct(F.lit(name).alias("_order"), F.struct(*key(cols)).alias("_key")) for name, cols in orders.items()])
    rows = df.select(F.inline(keys))

    # one row: the splitters of every order
    sample = df.select(keys.alias("_keys")).orderBy(F.xxhash64("_keys")).limit(SAMPLE).select(F.inline("_keys"))
    sorted_keys = F.sort_array(F.collect_list("_key"))
    every = F.greatest(F.lit(1), F.ceil(F.size("_all") / SPLITTERS))
    even = sample.groupBy("_order").agg(sorted_keys.alias("_all"))
    even = even.select("_order", F.filter("_all", lambda k, i: (i + 1) % every == 0).alias("_splitters"))
    splitters = even.agg(F.map_from_entries(F.collect_list(F.struct("_order", "_splitters")))).scalar()

    # the number of splitters below a key, by halving: a column for each step, as a loop over an array is not compiled
    parted = rows.withColumns({"_splitters": splitters[F.col("_order")], "_part": F.lit(0)})
    for step in (1 << i for i in reversed(range(SPLITTERS.bit_length()))):
        further = F.get(F.col("_splitters"), F.col("_part") + (step - 1)) < F.col("_key")
        parted = parted.withColumn("_part", F.col("_part") + F.when(further, step).otherwise(0))
    parted = parted.drop("_splitters")

    in_order, of_order = Window.partitionBy("_order").orderBy("_part"), Window.partitionBy("_order")
    wanted = F.array(
        *[F.struct(F.lit(t).alias("_tile"), rank(F.col("_n")).cast("bigint").alias("rank")) for t, rank in ntile_ends(n_tiles).items()]
    )
    counted = (
        parted.groupBy("_order", "_part")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumns({"upto": F.sum("cnt").over(in_order), "_n": F.sum("cnt").over(of_order)})
        .select("_order", "_part", "cnt", "upto", F.inline(wanted))
    )
    found = _holding_rank(counted, ["_order", "_part", "_tile"])
    # at most n_tiles - 1 rows for each order, and of the second pass as many parts; keys are unique, and so are their ranks
    place = F.rank().over(Window.partitionBy("_order", "_tile").orderBy("_key"))
    ends = parted.join(F.broadcast(found), ["_order", "_part"]).withColumn("place", place).where("place = rank")
    ends = ends.groupBy("_order").agg(F.collect_list("_key").alias("ends"))
    ends = ends.agg(F.map_from_entries(F.collect_list(F.struct("_order", "ends"))).alias("ends")).scalar()

    df = df.withColumn("_ends", ends)

    def tile(name: str, cols: Sequence[Column]) -> Column:
        own = F.struct(*key(cols))
        return F.size(F.filter(F.col("_ends")[name], lambda end: own > end)) + 1

    return df.withColumns({name: tile(name, cols) for name, cols in orders.items()}).drop("_ends")


def running_totals(df: DataFrame, value: str, totals: Sequence[str]) -> DataFrame:
    """Running and overall sums over rows ordered by ``value``, a column of whole numbers without repeated values.

    Adds ``<t>_upto`` and ``<t>_all`` for each column in ``totals``. Buckets by leading digits are totalled first (a
    bounded frame, the only one ordered in a single task), then every bucket is accumulated in a task of its own from
    its bucket's starting point.
    """
    df = df.withColumn("_bucket", leading_digits(F.col(value)))
    in_order = Window.partitionBy().orderBy("_bucket")
    everything = Window.partitionBy()
    starts = (
        df.groupBy("_bucket")
        .agg(*[F.sum(t).alias(t) for t in totals])
        .select(
            "_bucket",
            *[(F.sum(t).over(in_order) - F.col(t)).alias(f"_{t}_start") for t in totals],
            *[F.sum(t).over(everything).alias(f"{t}_all") for t in totals],
        )
    )
    inside = Window.partitionBy("_bucket").orderBy(value)
    running = {f"{t}_upto": F.col(f"_{t}_start") + F.sum(t).over(inside) for t in totals}
    joined = df.join(F.broadcast(starts), "_bucket").withColumns(running)
    return joined.drop("_bucket", *[f"_{t}_start" for t in totals])
