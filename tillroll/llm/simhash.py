"""SimHash near-duplicates with bit-sliced comparison.

``with_fingerprint`` gives every text 64 bits, the majority of the bits of its shingles' hashes. Fingerprints that differ
in at most ``radius`` bits are linked, ``near_groups`` names the connected groups.

Pairs are found without comparing everything. With the 64 bits cut into blocks, two fingerprints within the radius
agree in all blocks but ``radius``; so each combination of that many agreeing blocks is a bucket key, and every pair
meets in at least one bucket. Within a task all buckets are compared at once: the rows lie sorted by bucket, their bits
are stored as 64 vertical planes, and for each distance s in the order the planes are compared with themselves moved by
s rows. One XOR of machine words so compares 64 pairs in one bit, carry-save counters add the differences, and words
whose pairs all exceed the radius are abandoned. Of a bucket only as many links leave the task as join its groups.

Buckets with more than ``chunk`` rows are cut into chunks, and each pair of chunks is compared as a bucket of its own.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; equal texts have equal fingerprints
and are one node of the search however many they are; a null doc_id is never the smallest of a group, unless all are
null; an empty table gives an empty result; extra columns are kept by ``with_fingerprint`` and ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tillroll.llm.common import fresh, identity, join_grouped, join_uneven, saved
from tillroll.llm.components import components

SEED = 42
CHUNK = 4096
_LANES = 64
_SLICE = 65_536  # shingles counted at a time


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles, A-Z lower-cased; 0 without words."""
    words = (text or "").encode().lower().split()  # for bytes, both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1]
    stops = ends[shingle - 1 :] - 1
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), _SLICE):
        pairs = zip(starts[i : i + _SLICE].tolist(), stops[i : i + _SLICE].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", shingle: int = 4) -> DataFrame:
    """Adds the fingerprint as a signed BIGINT."""

    @pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, prints(F.col(text)))


def _block_plan(n: int, radius: int) -> list[int]:
    """Bit widths of the blocks: enough blocks that a bucket of random fingerprints stays small at ``n`` of them."""
    for blocks in range(radius + 2, max(2 * radius + 1, radius + 3)):
        if n >> (64 // blocks * (blocks - radius)) <= 4:
            break
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def _bucket_keys(fp: Column, widths: list[int], radius: int) -> Column:
    """One key per combination of agreeing blocks: number of the combination, and the bits of its blocks."""
    starts = np.cumsum([0, *widths]).tolist()
    keys = []
    for number, chosen in enumerate(combinations(range(len(widths)), len(widths) - radius)):
        value = F.lit(0).cast("bigint")
        for b in chosen:
            bits = F.shiftrightunsigned(fp, starts[b]).bitwiseAND(F.lit((1 << widths[b]) - 1).cast("bigint"))
            value = F.shiftleft(value, widths[b]).bitwiseOR(bits)
        keys.append(F.struct(F.lit(number).alias("combination"), value.alias("value")))
    return F.array(*keys)


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit b of row i as bit i % 64 of word i // 64 in plane b, with a spare word at the end."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return _packed(bits)


def _packed(bits: np.ndarray) -> np.ndarray:
    n = bits.shape[-1]
    words = -(-n // _LANES) + 1
    out = np.zeros((*bits.shape[:-1], words * 8), np.uint8)
    packed = np.packbits(bits, axis=-1, bitorder="little")
    out[..., : packed.shape[-1]] = packed
    return out.view("<u8")


def _moved(planes: np.ndarray, s: int, words: np.ndarray) -> np.ndarray:
    """The chosen words of the planes, with row i + s in the place of row i."""
    w, bit = divmod(s, _LANES)
    last = planes.shape[1] - 1
    low = planes[:, np.minimum(words + w, last)]
    if not bit:
        return low
    return (low >> np.uint64(bit)) | (planes[:, np.minimum(words + w + 1, last)] << np.uint64(_LANES - bit))


def close_pairs(fp: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of the same bucket within the radius, in batches by j - i; ``bucket`` is sorted."""
    rows = np.arange(len(fp))
    n_counters = int(radius).bit_length()
    s = 0
    while True:
        # keep the buckets that reach as far as the next distance
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        keep = np.repeat(sizes > s + 1, sizes)
        fp, bucket, rows = fp[keep], bucket[keep], rows[keep]
        if not len(fp):
            return
        planes = _planes(fp)
        for s in range(s + 1, 2 * s + 2):
            if s >= len(fp):
                return
            valid = _packed((bucket[s:] == bucket[:-s]).astype(np.uint8))
            words = np.flatnonzero(valid)
            alive = valid[words]
            counters = [np.zeros(len(words), "<u8") for _ in range(n_counters)]
            for b in range(0, 64, 8):
                differing = planes[b : b + 8][:, words] ^ _moved(planes[b : b + 8], s, words)
                for plane in differing:
                    carry = plane
                    for c in range(n_counters):
                        counters[c], carry = counters[c] ^ carry, counters[c] & carry
                    alive &= ~carry  # more than the counters hold
                alive &= ~_more_than(counters, radius)
                left = np.flatnonzero(alive)
                if len(left) < len(words):
                    words, alive = words[left], alive[left]
                    counters = [c[left] for c in counters]
                if not len(words):
                    break
            if len(words):
                lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
                first = (words[:, None] * _LANES + np.arange(_LANES))[lanes]
                yield rows[first], rows[first + s]


def _more_than(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter is above the limit."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for c in reversed(range(len(counters))):
        if limit >> c & 1:
            equal = equal & counters[c]
        else:
            above |= equal & counters[c]
            equal = equal & ~counters[c]
    return above


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """As many of the pairs as join what they connect."""
    parent = np.arange(n)
    out = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for i, j in pairs:
        label = parent.copy()
        while (label != (up := label[label])).any():
            label = up
        parent = label
        new = label[i] != label[j]
        for a, b in zip(i[new].tolist(), j[new].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out


def _links(radius: int):
    """Task: rows sorted by bucket; a bucket may go on in the next batch."""

    def linked(table: pa.Table) -> pa.RecordBatch:
        fp = table["fp"].to_numpy().view(np.uint64)
        keys = [table[c].to_numpy() for c in ("combination", "value", "pair")]
        new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)] if len(fp) else np.zeros(0, bool)
        found = spanning(len(fp), close_pairs(fp, np.cumsum(new), radius))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows < 8 * CHUNK:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            keys = [table[c].to_numpy() for c in ("combination", "value", "pair")]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield linked(table.slice(0, cut))
                waiting, rows = table.slice(cut).to_batches(), len(table) - cut
        if waiting:
            yield linked(pa.Table.from_batches(waiting).combine_chunks())

    return run


def near_links(prints: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp, each once) within the radius."""
    widths = _block_plan(prints.count(), radius)
    keys = prints.select("fp", F.explode(_bucket_keys(F.col("fp"), widths, radius)).alias("_k")).select("fp", "_k.*")
    # buckets are counted by partial sums, and only those of several chunks, one in ``chunk`` keys at most, are looked up
    large = keys.groupBy(F.col("combination").alias("_c"), F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    large = saved(large.filter(F.col("_n") > chunk), "buckets")
    same = (F.col("combination") == F.col("_c")) & (F.col("value") == F.col("_v"))
    sized = join_grouped(keys, large, same, "left")
    # a row of chunk c of k chunks goes to the pairs (c, 0) … (c, k - 1), named by the smaller chunk first
    k = F.coalesce(F.ceil(F.col("_n") / chunk).cast("int"), F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), k).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.least(mine, o) * k + F.greatest(mine, o))
    rows = sized.withColumn("pair", F.explode(F.when(k == 1, F.array(F.lit(0))).otherwise(pairs)))
    rows = rows.select("combination", "value", "pair", "fp")
    rows = rows.repartition("combination", "value", "pair").sortWithinPartitions("combination", "value", "pair", "fp")
    return rows.mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def near_groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, root) of all fingerprints: root is the same for all that are linked, directly or over others."""
    distinct = saved(prints.select("fp").distinct(), "fingerprints")
    roots = components(near_links(distinct, radius)).select(F.col("node").alias("_node"), "root")
    joined = distinct.join(roots, F.col("fp") == F.col("_node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp) with ``component_id``: the smallest doc_id of the group."""
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    groups = near_groups(prints, radius).withColumnsRenamed({"fp": "_fp"})
    named = saved(groups.join(firsts, F.col("_fp") == F.col("fp")).select("fp", "root", "_first", "_rows"), "groups")
    smallest = named.groupBy("root").agg(F.min("_first").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    smallest = saved(smallest.withColumnRenamed("root", "_root"), "components")
    # neither the fingerprints of one component nor the documents of one fingerprint are gathered
    ids = join_uneven(named, smallest, "root", "_root", "_n")
    ids = saved(ids.select(F.col("fp").alias("_fp"), "root", "component_id", "_rows"), "ids")
    return join_uneven(prints, ids, "fp", "_fp", "_rows").select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The documents, with all their columns, of which no earlier one (by doc_id, null last) is near."""
    names = docs.columns
    inner = [f"_doc{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    (fp,) = fresh(rows, "fp")
    rows = saved(with_fingerprint(rows, fp, inner[names.index(text)], shingle), "fingerprinted")
    doc_id = F.col(inner[names.index("doc_id")])
    light = rows.select(doc_id.alias("doc_id"), F.col(fp).alias("fp"))
    found = near_duplicates(light, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp")).alias("first")
    chosen = found.groupBy("root").agg(first).select("first.doc_id", "first.fp")
    unit = identity(F.col("doc_id"), F.col("fp"))
    chosen = chosen.select(unit[0].alias("_keep0"), unit[1].alias("_keep1"))
    unit = identity(doc_id, F.col(fp))
    rows = rows.withColumns({"_key0": unit[0], "_key1": unit[1]})
    rows = rows.join(chosen, (F.col("_key0") == F.col("_keep0")) & (F.col("_key1") == F.col("_keep1")), "left_semi")
    # equal rows: one of them; the join has brought them together already
    rows = rows.withColumn("_number", F.row_number().over(Window.partitionBy("_key0", "_key1").orderBy("_key0")))
    return rows.filter("_number = 1").select(*inner).toDF(*names)
