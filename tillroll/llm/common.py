"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
# up to so many rows a grouped side is broadcast; beyond, Spark joins by shuffling
BROADCAST_ROWS = 20_000
# a key with more rows is not gathered in one task, see ``join_uneven``
HOT_ROWS = 1_000


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tillroll-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session within one process, as in tests, can do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tillroll-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        candidate = f"_{name}"
        while candidate.lower() in taken:
            candidate = f"_{candidate}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def join_grouped(rows: DataFrame, grouped: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """Join with a grouped (saved) table; it is broadcast only after its rows were counted."""
    small = grouped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(grouped) if small else grouped, condition, how)


def join_uneven(rows: DataFrame, grouped: DataFrame, key: str, grouped_key: str, n: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join with a (saved) table of one row per key that knows the key's number ``n`` of ``rows``.

    Of the keys with more than ``hot`` rows, the ``BROADCAST_ROWS`` largest meet their rows where those are. The others are
    shuffled, and none of them has more than ``hot`` rows or one in ``BROADCAST_ROWS`` of all.
    """
    many = grouped.filter(F.col(n) > hot).orderBy(F.desc(n), grouped_key).limit(BROADCAST_ROWS)
    if many.isEmpty():
        return rows.join(grouped, F.col(key) == F.col(grouped_key)).drop(grouped_key, n)
    many = saved(many, "hot")
    (mark,) = fresh(rows, "hot")
    marks = F.broadcast(many.select(F.col(grouped_key).alias(mark)))
    marked = rows.join(marks, F.col(key) == F.col(mark), "left")
    large = marked.filter(F.col(mark).isNotNull()).drop(mark).join(F.broadcast(many), F.col(key) == F.col(grouped_key))
    others = grouped.join(marks, F.col(grouped_key) == F.col(mark), "left_anti")
    small = marked.filter(F.col(mark).isNull()).drop(mark).join(others, F.col(key) == F.col(grouped_key))
    return large.unionByName(small).drop(grouped_key, n)


def repeated(df: DataFrame, times: str, number: str, block: int = 10_000) -> DataFrame:
    """Every row ``times`` times with its ``number`` from 0; in blocks, so that no array grows with the count."""
    (b,) = fresh(df, "block")
    blocks = df.filter(F.col(times) > 0).withColumn(b, F.explode(F.sequence(F.lit(0), F.expr(f"(`{times}` - 1) div {block}"))))
    last = F.least(F.col(times), (F.col(b) + 1) * block) - 1
    return blocks.withColumn(number, F.explode(F.sequence(F.col(b) * block, last))).drop(b)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the values only."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def identity(*parts: Column) -> list[Column]:
    """Two hashes of the values, together 128 bits: equal for equal values only, as far as any table goes."""
    return [F.xxhash64(F.lit("a"), *parts), F.xxhash64(F.lit("b"), *parts)]


def usable(vector: Column, dim: int) -> Column:
    """Vectors of ``dim`` components, none of them null, NaN or infinite; also false for a null vector."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text (at least a row), so that a task's memory stays bounded."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        kind = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
        offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, kind.itemsize * column.offset)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end
