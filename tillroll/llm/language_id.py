"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over hashed byte n-grams tells the languages
with a 1 from those with a 0: naive Bayes, whose counts are taken by a grouped sum over all learned texts. A text's margins
are decoded to the nearest codeword, where each bit's loss is weighted by how well its classifier does on a bounded,
documented sample of the learned rows. Texts whose two nearest codewords lie close together are flagged as ambiguous.

Defined cases: a text that is null or has no letter is ``und`` with score 0 (and ambiguous); rows without a language are
not learned; with a single learned language everything with letters is given to it, with none everything is ``und``;
ties between languages go to the first by name; repeated rows count as often as they occur; an empty table gives an
empty result; extra columns are kept, but for old ones named lang_pred, score or ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tillroll.llm.common import slices

BUCKETS = 1 << 13
# rows of the learned table on which the classifiers are weighted, and any that equal the last of them
WEIGHTING_ROWS = 2_000
AMBIGUOUS = 0.15
UNKNOWN = "und"
_GRAMS = (2, 3)
# lower-cased ASCII letters and all that is not ASCII; other bytes become blanks
_TABLE = bytes(b if b > 127 or 97 <= b <= 122 else 32 for b in bytes(range(256)).lower())


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after the other, and where each text's begin."""
    raw = [b" %b " % t.encode().translate(_TABLE) for t in texts]
    buffer = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    starts = np.cumsum([0, *map(len, raw)])
    longest = max(_GRAMS)
    columns = []
    for n in _GRAMS:
        h = np.full(len(buffer), n, np.uint32)
        for i in range(n):
            h[: len(h) - i] = h[: len(h) - i] * np.uint32(0x01000193) ^ buffer[i:]  # fixed value: FNV-1a's prime, 32 bits
        columns.append((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    grams = np.stack(columns, axis=1)
    # n-grams that reach into the next text or consist of blanks only say nothing: they go to bucket 0
    position = np.arange(len(buffer)) - np.repeat(starts[:-1], np.diff(starts))
    cut = position > np.repeat(np.diff(starts), np.diff(starts)) - longest
    blank = (buffer == 32) & (np.r_[buffer[1:], 32] == 32)
    grams[cut | blank] = 0
    return grams, starts


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits: log odds of a 1
    loss_weights: np.ndarray  # languages x bits

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log odds per n-gram, text by bit."""
        grams, starts = _grams(texts)
        out = np.zeros((len(texts), self.code.shape[1]))
        for column in range(grams.shape[1]):
            out += np.add.reduceat(self.weights[grams[:, column]], starts[:-1], axis=0)
        known = np.add.reduceat((grams[:, 0] > 0).astype(np.int64), starts[:-1])
        return out / np.maximum(known, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, ambiguous): the codeword with the smallest weighted loss."""
        steep = np.clip(margins * 4, -6, 6)
        loss = (self.loss_weights[None] * np.log1p(np.exp(-self.code[None] * steep[:, None, :]))).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
        score = odds.max(axis=1) / odds.sum(axis=1)
        second = order[:, min(1, loss.shape[1] - 1)]
        best = order[:, 0]
        close = (loss.shape[1] > 1) & (loss[rows, second] - loss[rows, best] < AMBIGUOUS)
        return best, score, close


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1 that differ pairwise in about half their bits: rows of a Hadamard matrix.

    The columns that tell nothing apart are left out; at most twice as many bits as languages.
    """
    size = 1 << max(1, (n - 1).bit_length())
    i = np.arange(size)
    parity = np.bitwise_count(i[:, None] & i[None, :]) & 1
    code = 1 - 2 * parity[:n].astype(np.int64)
    return code[:, (code != code[0]).any(axis=0)] if n > 1 else code[:, :1]


COUNTS = "lang string, bucket int, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams per language and bucket, summed within the task."""
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches, "text"):
        grams, starts = _grams(batch.column("text").to_pylist())
        langs = batch.column("lang").dictionary_encode()
        of = np.repeat(langs.indices.to_numpy(), np.diff(starts))
        names = langs.dictionary.to_pylist()
        for column in range(grams.shape[1]):
            n = np.bincount(of * BUCKETS + grams[:, column], minlength=len(names) * BUCKETS).reshape(len(names), -1)
            for name, row in zip(names, n):
                totals[name] = totals.get(name, 0) + row
    for name, row in totals.items():
        at = np.flatnonzero(row)
        columns = [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> Model:
    """A model of the languages in (text, lang).

    The driver holds one count per language and bucket, 8,192 a language. ``WEIGHTING_ROWS`` texts weight the losses.
    """
    labelled = labelled.select("text", "lang").dropna()
    counts = labelled.mapInArrow(_count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.filter("bucket > 0").toPandas()
    languages = sorted(rows["lang"].unique())
    code = codewords(len(languages)) if languages else np.zeros((0, 1))
    table = np.zeros((len(languages), BUCKETS))
    number = {lang: i for i, lang in enumerate(languages)}
    table[rows["lang"].map(number).to_numpy(np.int64), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)  # each language weighs the same
    weights = np.zeros((BUCKETS, code.shape[1]))
    for b in range(code.shape[1]) if len(languages) > 1 else ():
        weights[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    weights[0] = 0
    model = Model(languages, code, weights.astype(np.float32), np.full(code.shape, 1 / max(1, code.shape[1])))
    if len(languages) < 2:
        return model
    # rows up to the hash of the last sampled one; they are decoded where they are, and only sums reach the driver
    place = F.xxhash64("text", "lang")
    last = labelled.select(place.alias("place")).orderBy("place").limit(WEIGHTING_ROWS).agg(F.max("place")).first()[0]
    sample = labelled.filter(place <= F.lit(last))
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    rated = sample.mapInArrow(_rate(shared), "lang string, bit int, fits bigint, n bigint")
    rated = rated.groupBy("lang", "bit").agg(F.sum("fits").alias("fits"), F.sum("n").alias("n")).toPandas()
    accuracy = np.full(code.shape, 0.5)
    rates = ((rated["fits"] + 1) / (rated["n"] + 2)).to_numpy(float)
    accuracy[rated["lang"].map(number).to_numpy(np.int64), rated["bit"].to_numpy()] = rates
    return Model(languages, code, model.weights, accuracy / accuracy.sum(axis=1, keepdims=True))


def _rate(model):
    """Task: per language and bit, how many texts' margins have the sign of the codeword."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        number = {lang: i for i, lang in enumerate(known.languages)}
        for batch in slices(batches, "text"):
            margins = known.margins(batch.column("text").to_pylist())
            own = np.array([number[lang] for lang in batch.column("lang").to_pylist()])
            fits = margins * known.code[own] > 0
            rows = [
                (known.languages[i], b, int(fits[own == i, b].sum()), int((own == i).sum()))
                for i in np.unique(own)
                for b in range(known.code.shape[1])
            ]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "bit", "fits", "n"])

    return run


def _predict(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model = model.value
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            lang = np.array([UNKNOWN] * len(texts), object)
            score, ambiguous = np.zeros(len(texts)), np.ones(len(texts), bool)
            at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            if at and known.languages:
                best, score[at], ambiguous[at] = known.decode(known.margins([texts[i] for i in at]))
                lang[at] = np.array(known.languages, object)[best]
            kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != text]
            found = [pa.array(lang, pa.string()), pa.array(score), pa.array(ambiguous)]
            names = [*(n for n, _ in kept), "lang_pred", "score", "ambiguous"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *found], names)

    return run


def predict(spark: SparkSession, model: Model, docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with lang_pred, score (0 to 1) and ``ambiguous``."""
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "ambiguous")]
    inner = [f"_doc{i}" for i in range(len(names))]
    rows = docs.select(*names).toDF(*inner)
    own = inner[names.index(text)]
    found = [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("ambiguous", BooleanType()),
    ]
    schema = StructType([*[f for f in rows.schema.fields if f.name != own], *found])
    out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), own), schema)
    return out.toDF(*[c for c in names if c != text], "lang_pred", "score", "ambiguous")
