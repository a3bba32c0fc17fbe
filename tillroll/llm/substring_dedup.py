"""Exact substring duplicates by FM-indexes of shards.

A window is ``window`` consecutive words of one document; every word covered by a window that also starts elsewhere is a
duplicate. To keep searches local, windows are dealt to shards by content: a window belongs to the smallest hash among
its runs of ``GRAM`` words (its anchor), so equal windows share it. Consecutive windows with the same anchor are one
segment of words.

1. ``_anchors``: every text gives its segments as (anchor, start, windows, occurrences of the anchor).
2. Anchors that occur once in the whole corpus cannot belong to a repeated window; their segments end here.
3. The others are cut out of their texts (equal texts once) and shuffled by anchor. What repeats within a batch of texts is
   a duplicate already, and only one copy of it travels.
4. A task turns segments of whole anchors into an FM-index over its words, streams the segments backwards through it, and
   gets matching statistics: for each right end, how far to the left words still occur twice. Intervals of at least
   ``window`` words are reported.
5. Intervals meet the texts again, by their hashes.

An anchor that occurs more than ``hot`` times does not travel as segments but as single windows, dealt by their own
hash: equal ones merge in the batches, and no task holds them all. Equal texts are searched once, with their number.

Defined cases: null and blank texts have no words and lose none; texts shorter than the window lose none; repeated rows
repeat their windows; an empty table gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import identity, saved, slices
from tillroll.llm.fm_index import FMIndex

WINDOW = 35
GRAM = 8
HOT = 50_000
SHARD_WORDS = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 divided by the golden ratio, odd


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # for bytes, blanks are the ASCII ones


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """All words of the texts as numbers from 0, the vocabulary, and where each text starts."""
    vocabulary: dict[bytes, int] = {}
    put, size = vocabulary.setdefault, vocabulary.__len__
    numbers = np.array([put(w, size()) for text in texts for w in text], np.int64)
    starts = np.cumsum([0, *map(len, texts)])
    return numbers, vocabulary, starts


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER
    return h ^ (h >> np.uint64(29))


def _run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive words, from the hashes of the words."""
    out = np.zeros(max(len(h) - length + 1, 0), np.uint64)
    for i in range(length if len(out) else 0):
        out = out * _MULTIPLIER + h[i : i + len(out)]
    return _mixed(out)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[: len(out) - step], out[step:])
        reach += step
    return out


def segments(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, text, start, windows, occurrences) of all segments; ``h`` are the hashes of all words of all texts."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none.view(np.uint64), none, none, none, none
    grams = _run_hashes(h, GRAM)
    minima = _window_minima(grams, window - GRAM + 1)
    text = np.searchsorted(starts, np.arange(len(minima)), side="right") - 1
    inside = np.arange(len(minima)) + window <= starts[text + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return none.view(np.uint64), none, none, none, none
    minima, text = minima[at], text[at]
    new = np.r_[True, (minima[1:] != minima[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    anchor, start, of = minima[first], at[first], text[first]
    # how often the anchor occurs in the segment: an anchor that fills windows may occur several times
    length = count + window - GRAM
    segment = np.repeat(np.arange(len(first)), length)
    offset = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    same = grams[start[segment] + offset] == anchor[segment]
    times = np.bincount(segment[same], minlength=len(first))
    return anchor, of, start - starts[of], count, times


def _hashed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    numbers, vocabulary, starts = _numbers(texts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    return _mixed(hashes)[numbers] if len(numbers) else numbers.view(np.uint64), starts


ANCHORS = "h bigint, k0 bigint, k1 bigint, start int, windows int, times int"


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, starts = _hashed([words(t) for t in batch.column("text").to_pylist()])
            anchor, of, start, count, times = segments(h, starts, window)
            yield pa.RecordBatch.from_pydict(
                {
                    "h": pa.array(anchor.view(np.int64)),
                    "k0": batch.column("k0").take(pa.array(of)),
                    "k1": batch.column("k1").take(pa.array(of)),
                    "start": pa.array(start, pa.int32()),
                    "windows": pa.array(count, pa.int32()),
                    "times": pa.array(times, pa.int32()),
                }
            )

    return run


PIECES = "h bigint, body binary, k0 bigint, k1 bigint, start int, windows int"


def _cut(window: int):
    """Task: texts with their wanted segments. Gives pieces to be indexed, and intervals (without a body) known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[tuple] = []
            seen: dict[tuple[int, bytes], list] = {}

            def offer(h: int, body: bytes, k0: int, k1: int, start: int, windows: int, copies: int) -> None:
                known = seen.get((h, body))
                if known is None:
                    seen[h, body] = [k0, k1, start, windows, copies > 1]
                    out.append((h, body, k0, k1, start, windows))
                else:
                    out.append((k0, None, k0, k1, start, windows))
                    if not known[4]:
                        known[4] = True
                        out.append((known[0], None, *known[:4]))
                if known is None and copies > 1:
                    out.append((k0, None, k0, k1, start, windows))

            for row in batch.to_pylist():
                text = words(row["text"])
                for s in row["wanted"]:
                    at, n = s["start"], s["windows"]
                    if not s["hot"]:
                        body = b" ".join(text[at : at + n + window - 1])
                        offer(s["h"], body, row["k0"], row["k1"], at, n, row["copies"])
                        continue
                    for i in range(at, at + n):
                        body = b" ".join(text[i : i + window])
                        h = xxhash.xxh64_intdigest(body) - (1 << 63)
                        offer(h, body, row["k0"], row["k1"], i, 1, row["copies"])
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            names = ["h", "body", "k0", "k1", "start", "windows"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def matches(bodies: list[list[bytes]], window: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, last) of the longest stretches, of a window or more, that occur twice among the texts.

    All texts are streamed through the index in step, from right to left; a stretch that no longer occurs twice is
    reported, and the next one starts at the rightmost end that can still give a window of its own.
    """
    numbers, vocabulary, starts = _numbers(bodies)
    lengths = np.diff(starts)
    symbols = np.zeros(len(numbers) + len(bodies), np.int64)
    begin = starts[:-1] + np.arange(len(bodies))
    symbols[np.arange(len(numbers)) + np.repeat(np.arange(len(bodies)), lengths)] = numbers + 1
    index = FMIndex(symbols, len(vocabulary))
    lane = np.flatnonzero(lengths >= window)
    end = lengths[lane] - 1  # right end of the stretch
    at = end.copy()  # word to be added on the left
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    while len(lane):
        lower, upper = index.extend(symbols[begin[lane] + at], low, high)
        twice = upper - lower >= 2
        low, high = np.where(twice, lower, 0), np.where(twice, upper, index.n)
        at = np.where(twice, at - 1, at)
        stop = ~twice | (at < 0)
        found = np.flatnonzero(stop & (end - at >= window))
        yield from zip(lane[found].tolist(), (at[found] + 1).tolist(), end[found].tolist())
        following = np.minimum(end - 1, at + window - 1)
        end = np.where(stop, following, end)
        at = np.where(stop, following, at)
        low, high = np.where(stop, 0, low), np.where(stop, index.n, high)
        left = ~(stop & (following < window - 1))
        lane, end, at, low, high = lane[left], end[left], at[left], low[left], high[left]


INTERVALS = "k0 bigint, k1 bigint, first int, last int"


def _match(window: int):
    """Task: pieces sorted by anchor. Whole anchors are gathered to shards of about ``SHARD_WORDS`` words."""

    def shard(pieces: list[dict]) -> Iterator[tuple[int, int, int, int]]:
        unique: dict[bytes, list[dict]] = {}
        for piece in pieces:
            unique.setdefault(piece["body"], []).append(piece)
        for body, same in unique.items():
            if len(same) > 1:
                for p in same:
                    yield p["k0"], p["k1"], p["start"], p["start"] + p["windows"] + window - 2
        own = list(unique.values())
        for i, first, last in matches([body.split(b" ") for body in unique], window):
            for p in own[i]:
                yield p["k0"], p["k1"], p["start"] + first, p["start"] + last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k0", "k1", "first", "last"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        pieces: list[dict] = []
        total = 0
        for batch in batches:
            done = batch.filter(pc.is_null(batch.column("body")))
            ends = pc.add(pc.add(done.column("start"), done.column("windows")), pa.scalar(window - 2, pa.int32()))
            yield pa.RecordBatch.from_arrays([done.column("k0"), done.column("k1"), done.column("start"), ends], names)
            for row in batch.filter(pc.is_valid(batch.column("body"))).to_pylist():
                if total >= SHARD_WORDS and row["h"] != pieces[-1]["h"]:
                    yield sent(list(shard(pieces)))
                    pieces, total = [], 0
                pieces.append(row)
                total += row["windows"] + window - 1
        if pieces:
            yield sent(list(shard(pieces)))

    return run


RESULT = "k0 bigint, k1 bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _removed(with_text: bool):
    """Task: texts with their intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                text = words(text)
                kept, end = [], 0
                for c in sorted(cuts or (), key=lambda c: c["first"]):
                    kept += text[end : c["first"]]
                    end = max(end, c["last"] + 1)
                kept += text[end:]
                whole = b" ".join(kept)
                sha = hashlib.sha256(whole).hexdigest()
                rows.append((len(text), len(text) - len(kept), sha, whole.decode() if with_text else None))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column("k0"), batch.column("k1"), *[pa.array(c, k) for c, k in zip(columns, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, ["k0", "k1", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def repeated_intervals(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (k0, k1, text, copies), and the intervals (k0, k1, first, last) of their words that repeat."""
    keys = identity(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), keys[0].alias("k0"), keys[1].alias("k1"))
    anchors = saved(keyed.mapInArrow(_anchors(window), ANCHORS), "anchors")
    counts = anchors.groupBy(F.col("h").alias("_h")).agg(F.sum("times").alias("n")).filter("n > 1")
    wanted = anchors.join(counts, F.col("h") == F.col("_h"))
    each = F.struct("start", "windows", "h", (F.col("n") > hot).alias("hot"))
    wanted = wanted.groupBy(F.col("k0").alias("_k0"), F.col("k1").alias("_k1")).agg(F.collect_set(each).alias("wanted"))
    texts = keyed.groupBy("k0", "k1").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    same = (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1"))
    pieces = texts.join(wanted, same).select("k0", "k1", "text", "copies", "wanted").mapInArrow(_cut(window), PIECES)
    pieces = pieces.repartition("h").sortWithinPartitions("h")
    return texts, pieces.mapInArrow(_match(window), INTERVALS)


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): ``kept`` are the words left, joined by one space."""
    texts, intervals = repeated_intervals(docs, window, hot)
    cuts = intervals.groupBy(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"))
    cuts = cuts.agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    same = (F.col("k0") == F.col("_k0")) & (F.col("k1") == F.col("_k1"))
    # the same columns as above: Spark then shuffles the texts once
    rows = texts.join(cuts, same, "left").select("k0", "k1", "text", "copies", "cuts")
    rows = rows.mapInArrow(_removed(with_text), RESULT)
    keys = identity(F.coalesce(F.col("text"), F.lit("")))
    light = docs.select("doc_id", keys[0].alias("_k0"), keys[1].alias("_k1"))
    rows = light.join(rows, same)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text)
