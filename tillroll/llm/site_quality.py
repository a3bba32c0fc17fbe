"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes classifier over the presence of hashed words and of binned measures of its
shape (symbols, repetition, lengths), learned from a bounded sample of the labelled documents; only features with large
and significant log odds count. Its site gives the prior: the share of bad documents of its host and of its path, from all labels,
where a path is shrunk to its host and a host to all by beta priors whose strength is estimated from how much sites
really differ. Sparse sites so fall back to what is known above them. Both are added as log odds.

Sites are grouped sums; they meet the documents after the texts have been read, so that only ids and scores are joined.

Defined cases: null and empty texts have their shape as evidence; a null host or path is a site of its own; documents
with several labels count with each; with no labels at all every document has probability 0.5 of either; repeated rows are
judged each for itself; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import join_grouped, saved, slices
from tillroll.llm.decontamination import words

# labelled documents that the classifier learns from, the smallest by the hash of their id
LEARNED_ROWS = 20_000
SIGNIFICANT = 3.0
# and so must be their size: long texts have a little more of every word
EFFECT = 3.0
# bounds of the log odds that a text may add, and of the estimated strength of a site's prior
MOST_EVIDENCE = 12.0
STRENGTH = (1.0, 10_000.0)
TARGETS = ("low", "toxic")


def _bin(x: float) -> int:
    return min(10, int(10 * x))


def features(text: str | None) -> set[bytes]:
    """What is present in a text: its words, and its shape in coarse bins."""
    text = text or ""
    blanks, plain = text.split(), words(text)
    n = len(blanks)
    found = set(plain)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(blanks, blanks[1:])))
    symbols = sum(map(text.count, "#*$%&|<>"))
    shape = {
        "words": min(12, n.bit_length()),
        "length": min(20, len(text.replace(" ", "")) // max(1, n)),
        "symbols": _bin(symbols / max(1, n)),
        "pairs": _bin(1 - pairs / (n - 1)) if n > 1 else -1,
        "same": _bin(sum(a == b for a, b in zip(blanks, blanks[1:])) / max(1, n)),
        "lines": _bin(1 - len(set(lines)) / max(1, len(lines))),
        "upper": _bin(sum(map(str.isupper, blanks)) / max(1, n)),
    }
    return found | {f" {name} {value}".encode() for name, value in shape.items()}


def _presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all features, each once."""
    hashes: dict[bytes, int] = {}
    rows = []
    for text in texts:
        own = features(text)
        for f in own:
            if f not in hashes:
                hashes[f] = xxhash.xxh64_intdigest(f) - (1 << 63)
        rows.append(np.fromiter(map(hashes.get, own), np.int64, len(own)))
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows])


COUNTS = "feature bigint, n bigint, low bigint, toxic bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature, and bad ones, summed within a slice."""
    for batch in slices(batches, "text"):
        doc, feature = _presence(batch.column("text").to_pylist())
        known, at = np.unique(feature, return_inverse=True)
        bad = [np.ones(batch.num_rows), *(batch.column(t).to_numpy(zero_copy_only=False) for t in TARGETS)]
        sums = [np.bincount(at, weight[doc], len(known)).astype(np.int64) for weight in bad]
        yield pa.RecordBatch.from_arrays([pa.array(known), *map(pa.array, sums)], ["feature", "n", *TARGETS])


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # hashes, sorted
    weights: np.ndarray  # features x targets: log odds that a present feature adds

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        doc, feature = _presence(texts)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        known = self.features[at] == feature
        sums = [np.bincount(doc[known], w[at[known]], len(texts)) for w in self.weights.T]
        return np.clip(np.stack(sums, axis=1), -MOST_EVIDENCE, MOST_EVIDENCE)


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARNED_ROWS) -> Model:
    """Classifiers for both targets from ``rows`` labelled documents. The driver sees the features that count."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), *TARGETS).limit(rows)
    labelled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    labelled = labelled.select("text", *[F.col(t).cast("double").alias(t) for t in TARGETS])
    counts = labelled.mapInArrow(_count, COUNTS)
    counts = counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    learned = docs.select("doc_id").join(F.broadcast(chosen), "doc_id")
    total = learned.agg(*[F.sum(t).alias(t) for t in TARGETS], F.count(F.lit(1)).alias("n")).first()
    weights = {}
    for t in TARGETS:
        bad, good = total[t] or 0, total["n"] - (total[t] or 0)
        with_bad, with_good = F.col(t) + 0.5, F.col("n") - F.col(t) + 0.5
        odds = F.log(with_bad / (bad + 1.0)) - F.log(with_good / (good + 1.0))
        size = F.abs(odds)
        large = (size > SIGNIFICANT * F.sqrt(1 / with_bad + 1 / with_good)) & (size > EFFECT)
        weights[f"w_{t}"] = F.when(large & F.lit(bad > 0 and good > 0), odds).otherwise(0.0)
    found = counts.select("feature", *[w.alias(name) for name, w in weights.items()])
    found = found.filter(" OR ".join(f"{w} != 0" for w in weights)).orderBy("feature").collect()
    table = np.array([row[1:] for row in found], float).reshape(-1, len(TARGETS))
    none = [(0, *[0.0] * len(TARGETS))]
    return Model(np.array([row[0] for row in found or none], np.int64), table if found else np.zeros((1, len(TARGETS))))


def _score(model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = model.value.evidence(batch.column("text").to_pylist())
            arrays = [*(batch.column(c) for c in kept), *(pa.array(column) for column in found.T)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *TARGETS])

    return run


def _shrunk(groups: DataFrame, target: str, prior: Column) -> Column:
    """Posterior mean of a group's share: its own counts and a beta prior around ``prior``.

    The strength of the prior is that of a beta-binomial by the method of moments: the less the groups differ beyond
    chance, the stronger.
    """
    bad, n = F.col(target), F.col("n")
    p = F.try_divide(bad, n)
    spread = groups.filter("n > 0").agg(
        F.sum(n * F.pow(p - prior, 2)).alias("ss"),
        F.sum(n * prior * (1 - prior)).alias("binomial"),
        F.sum(prior * (1 - prior)).alias("chance"),
        F.sum(n).alias("n"),
    ).first()
    strength = STRENGTH[1]
    if spread["n"] and spread["ss"] > spread["chance"]:
        between = (spread["ss"] - spread["chance"]) / spread["n"]
        strength = min(max(spread["binomial"] / spread["n"] / between - 1, STRENGTH[0]), STRENGTH[1])
    return (bad + strength * prior) / (n + strength)


def site_posteriors(sites: DataFrame) -> DataFrame:
    """(host, path, low, toxic): posterior shares per path, from (host, path, n, low, toxic) sums of labels."""
    total = sites.agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).first()
    hosts = sites.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    hosts = saved(hosts, "hosts")
    whole = {t: (total[t] + 0.5) / (total["n"] + 1) if total["n"] else 0.5 for t in TARGETS}
    by_host = hosts.select(
        F.col("host").alias("_host"),
        *[_shrunk(hosts, t, F.lit(float(whole[t]))).alias(f"host_{t}") for t in TARGETS],
    )
    paths = saved(join_grouped(sites, saved(by_host, "by_host"), F.col("host").eqNullSafe(F.col("_host"))), "paths")
    return paths.select(
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        *[_shrunk(paths, t, F.col(f"host_{t}")).alias(f"site_{t}") for t in TARGETS],
    )


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, low, toxic, site_low, site_toxic, is_low, is_toxic, kept) of (doc_id, text, host, path).

    ``labels`` are (doc_id, low 0/1, toxic 0/1). low and toxic are probabilities.
    """
    labels = labels.select("doc_id", *TARGETS).dropna()
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    kept = ["doc_id", "host", "path"]
    texts = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([*(f"{c} {dict(docs.dtypes)[c]}" for c in kept), *(f"{t} double" for t in TARGETS)])
    rows = texts.mapInArrow(_score(model, kept), schema)
    per_doc = labels.groupBy(F.col("doc_id").alias("_doc_id")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(t).alias(f"_{t}") for t in TARGETS]
    )
    light = docs.select(*kept).join(per_doc, F.col("doc_id") == F.col("_doc_id"), "left")
    sums = [F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in ("n", *TARGETS)]
    sites = saved(site_posteriors(saved(light.groupBy("host", "path").agg(*sums), "sites")), "posteriors")
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    rows = join_grouped(rows, sites, same).drop("_host", "_path")
    chances = {t: 1 / (1 + F.exp(-(F.col(t) + F.log(F.col(f"site_{t}") / (1 - F.col(f"site_{t}")))))) for t in TARGETS}
    rows = rows.withColumns(chances)
    rows = rows.withColumns({f"is_{t}": F.col(t) >= threshold for t in TARGETS})
    return rows.withColumn("kept", ~F.col("is_low") & ~F.col("is_toxic"))
