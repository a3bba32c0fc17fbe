"""Benchmark decontamination with an FM-index per training shard.

A benchmark item is searched by its windows of ``window`` words (a shorter item by all its words). A shard is some 16 MB of
documents in a task: their words become numbers of the benchmark's vocabulary, an FM-index is built over them, all
windows are searched backwards at once, occurrences are located by sampled suffix positions, and overlapping ones are
merged to removal spans. Runs of benchmark words that are shorter than the shortest window cannot hold an occurrence and
stay outside the index, and so does every other word. There is no shuffle; a lost task is simply run again.

The windows are broadcast in blocks of at most ``block_words`` benchmark words; each block is one more search of the
same shards, in the same pass over the documents. (An item larger than that makes a larger block.)

Defined cases: null texts have no words and no spans; items without words are ignored; items that repeat are found
under each of their ids, a null id is found but not named (``unnamed=True`` gives a null for it); repeated rows are
searched each for itself; empty tables give empty results, or no spans; extra columns are kept, but for old ones named
spans, items or n_words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tillroll.llm.common import saved, slices
from tillroll.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_WORDS = 2_000_000
SHARD_BYTES = 1 << 24
_LETTER = rb"[0-9a-z\x80-\xff]"
# bytes of words as they are, lower-cased; all others as blanks
_TABLE = bytes(b if re.match(_LETTER, bytes([b])) else 32 for b in bytes(range(256)).lower())

_SPAN = StructType([StructField("first", IntegerType()), StructField("last", IntegerType())])
# marks the documents that a task has cut
CUT = "_was_cut"
FOUND = [
    StructField("n_words", LongType()),
    StructField("spans", ArrayType(_SPAN)),
    StructField("items", ArrayType(StringType())),
]
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    """Words of the text: digits, a-z after lower-casing, and all that is not ASCII."""
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The windows of some items, as rows of word numbers, one matrix per length."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        # a null id comes last
        self.ids = sorted({i for i, _ in items}, key=lambda i: (i is None, i or ""))
        number = {item: i for i, item in enumerate(self.ids)}
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            length = min(window, len(symbols))
            for i in range(len(symbols) - length + 1 if symbols else 0):
                of = found.setdefault(length, {}).setdefault(tuple(symbols[i : i + length]), set())
                of.add(number[item])
        self.matrices = [(n, np.array(list(rows), np.int64), list(rows.values())) for n, rows in sorted(found.items())]
        self.shortest = min(found, default=0)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ordered spans (first and last word) that neither overlap nor repeat."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def occurrences(numbers: list[list[int]], phrases: Phrases) -> Iterator[tuple[int, int, int, set[int]]]:
    """(document, first word, last word, items) of every occurrence in a shard; 0 stands for other words."""
    lengths = np.fromiter(map(len, numbers), np.int64, len(numbers))
    if not phrases.matrices or not lengths.sum():
        return
    symbols = np.fromiter((s for doc in numbers for s in (*doc, 0)), np.int64, int((lengths + 1).sum()))
    starts = np.cumsum(lengths + 1) - lengths - 1
    # keep runs of benchmark words that can hold a window, each with the 0 behind it
    known = symbols > 0
    edges = np.flatnonzero(np.diff(np.r_[False, known].astype(np.int8)))
    run_start, run_end = edges[0::2], edges[1::2]
    long = run_end - run_start >= phrases.shortest
    run_start, run_end = run_start[long], run_end[long]
    if not len(run_start):
        return
    sizes = run_end - run_start + 1
    offset = np.cumsum(sizes) - sizes
    source = np.repeat(run_start - offset, sizes) + np.arange(int(sizes.sum()))
    index = FMIndex(symbols[source], len(phrases.vocabulary))
    for length, matrix, items in phrases.matrices:
        low, high = index.search(matrix)
        hit = np.flatnonzero(low < high)
        times = (high - low)[hit]
        rows = np.repeat(low[hit] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        position = source[index.locate(rows)]
        doc = np.searchsorted(starts, position, side="right") - 1
        first = position - starts[doc]
        for w, d, f in zip(np.repeat(hit, times).tolist(), doc.tolist(), first.tolist()):
            yield d, f, f + length - 1, items[w]


def _search(phrases, text: str, again: bool, returned: list[str], unnamed: bool):
    """Task: every batch of documents is a shard. ``again``: adds to what an earlier block found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = phrases.value
        get = sought.vocabulary.get
        for batch in slices(batches, text, SHARD_BYTES):
            numbers = [[get(w, 0) for w in words(t)] for t in batch.column(text).to_pylist()]
            if again:
                spans = [[(s["first"], s["last"]) for s in row] for row in batch.column("spans").to_pylist()]
                items = [set(row) for row in batch.column("items").to_pylist()]
            else:
                spans, items = [[] for _ in numbers], [set() for _ in numbers]
            for doc, first, last, of in occurrences(numbers, sought):
                spans[doc].append((first, last))
                items[doc].update(sought.ids[i] for i in of)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["n_words"] = pa.array(map(len, numbers), pa.int64())
            merged = [[{"first": a, "last": b} for a, b in _merged(row)] for row in spans]
            columns["spans"] = pa.array(merged, _SPANS)
            named = [sorted(row - {None}) + [None] * (unnamed and None in row) for row in items]
            columns["items"] = pa.array(named, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict({name: columns[name] for name in returned})

    return run


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int) -> tuple[int, Iterator]:
    """Number of blocks, and the broadcast phrases of each."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).dropna(subset="text")
    # every word but the last has a byte behind it that is none
    size = items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    n = int(size // block_words) + 1
    parts = (
        items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block) if n > 1 else items for block in range(n)
    )
    return n, (spark.sparkContext.broadcast(Phrases([tuple(row) for row in own.collect()], window)) for own in parts)


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep_text: bool = True,
    unnamed: bool = False,
) -> DataFrame:
    """``docs`` with n_words, ``spans`` (merged occurrences, by first and last word) and ``items`` (ids as strings).

    ``keep_text=False`` leaves the texts out of the result, which then need not travel back from Python. ``unnamed=True``
    ends ``items`` with a null if an item without an id was found.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "spans", "items")])
    names = docs.columns
    inner = [f"_doc{i}" for i in range(len(names))]
    out = docs.toDF(*inner)
    fields = out.schema.fields
    text = inner[names.index(text)]
    n, blocks = _blocks(spark, benchmark, window, block_words)
    for block, phrases in enumerate(blocks):
        last = block == n - 1
        kept = [f for f in fields if keep_text or not last or f.name != text]
        schema = StructType([*kept, *FOUND])
        out = out.mapInArrow(_search(phrases, text, block > 0, schema.names, unnamed), schema)
        if not last:  # what was found is written, so that one block's phrases are in memory at a time
            out = saved(out, f"block{block}")
            phrases.unpersist()
    return out.toDF(*[c for i, c in enumerate(names) if keep_text or inner[i] != text], "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without what stands between them."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in re.finditer(_LETTER + b"+", raw.translate(_TABLE))]
    out, end = [], 0
    for first, last in spans:
        out.append(raw[end : at[first][0]])
        end = at[last][1]
    return b"".join([*out, raw[end:]]).decode()


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The result of ``find_spans`` with the spans cut out of the texts; null texts stay null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t and cut_spans(t, [(s["first"], s["last"]) for s in row]) for t, row in zip(texts, spans)])

    return found.withColumn(text, cut(F.col(text), F.col("spans"))).drop("n_words", "spans", "items")


def _cut(phrases, text: str, n_chars: str | None):
    """Task: cuts the phrases out until none is left; a document that has no words then goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = phrases.value
        get = sought.vocabulary.get
        for batch in slices(batches, text, SHARD_BYTES):
            texts = batch.column(text).to_pylist()
            cut: set[int] = set()
            rows = list(range(len(texts)))
            while rows:  # a cut joins what stood around it
                spans: dict[int, list[tuple[int, int]]] = {}
                numbers = [[get(w, 0) for w in words(texts[i])] for i in rows]
                for doc, first, last, _ in occurrences(numbers, sought):
                    spans.setdefault(rows[doc], []).append((first, last))
                for i, found in spans.items():
                    texts[i] = cut_spans(texts[i], _merged(found))
                rows = sorted(spans)
                cut.update(rows)
            columns = dict(zip(batch.schema.names, batch.columns))
            columns[text] = pa.array(texts, columns[text].type)
            columns[CUT] = pa.array([i in cut for i in range(len(texts))], pa.bool_())
            if n_chars and cut:
                old = columns[n_chars]
                sizes = [len(texts[i]) if i in cut and v is not None else v for i, v in enumerate(old.to_pylist())]
                columns[n_chars] = pa.array(sizes, old.type)
            left = pa.array([i not in cut or bool(words(t)) for i, t in enumerate(texts)], pa.bool_())
            yield pa.RecordBatch.from_pydict(columns).filter(left)

    return run


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents, with all their columns, without the benchmark.

    A document with a full window goes. Items shorter than a window are cut out of the others (an integer ``n_chars`` then
    is the new length); only a document of which no word is left goes.
    """
    names = docs.columns
    inner = [f"_clean{i}" for i in range(len(names))]
    rows = docs.toDF(*inner)
    text = inner[names.index("text")]
    n_words = F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z[^\x00-\x7F]]+"), F.lit(0)))
    found = find_spans(rows, benchmark.filter(n_words >= window), text, window, block_words)
    out = found.filter(F.size("spans") == 0).select(*inner)
    if not benchmark.filter((n_words > 0) & (n_words < window)).isEmpty():
        integer = "n_chars" in names and dict(docs.dtypes)["n_chars"] in ("int", "bigint")
        n_chars = inner[names.index("n_chars")] if integer else None
        # full windows that a cut makes are cut as well, and what a block's cut joins may be another block's: until nothing is
        schema = StructType([*rows.schema.fields, StructField(CUT, BooleanType())])
        while True:
            n, blocks = _blocks(rows.sparkSession, benchmark, window, block_words)
            changed = False
            for phrases in blocks:
                out = out.drop(CUT).mapInArrow(_cut(phrases, text, n_chars), schema)
                if n > 1:
                    out = saved(out, "cut")
                    phrases.unpersist()
                    changed |= not out.filter(CUT).isEmpty()
            if not changed:
                break
        out = out.drop(CUT)
    return out.toDF(*names)
