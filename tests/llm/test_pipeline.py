"""The pipeline's stages, one after the other, against plain versions of what each must do."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from compare import duck
from test_agreement import brute_print, groups_by_brute_force
from tillroll.llm import queries

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage leaves, written and read again as on a cluster."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs.collect()
    return out


def test_the_stages_stand_in_order():
    names = ["quality_rules", "simhash", "decontamination", "mixing", "sharding"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names


def test_rules_keep_what_sql_keeps(kept):
    rows = duck(SF_DIR).execute(f"SELECT doc_id FROM ({queries.OP7_SQL}) WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in kept["quality_rules"]) == sorted(r[0] for r in rows)


def test_one_document_of_each_group_stays(kept):
    before = kept["quality_rules"]
    groups = groups_by_brute_force([(r["doc_id"], brute_print(r["text"])) for r in before])
    assert sorted(r["doc_id"] for r in kept["simhash"]) == sorted({component for _, _, component in groups})
    assert {tuple(r) for r in kept["simhash"]} <= {tuple(r) for r in before}


def test_documents_with_a_benchmark_window_go(kept):
    windows = set()
    for (text,) in duck(SF_DIR).execute("SELECT text FROM benchmark").fetchall():
        found = lowered_words(text)
        n = min(10, len(found))
        windows |= {tuple(found[i : i + n]) for i in range(len(found) - n + 1) if found}
    lengths = {len(w) for w in windows}

    def clean(text):
        found = lowered_words(text)
        return not any(tuple(found[i : i + n]) in windows for n in lengths for i in range(len(found) - n + 1))

    expected = sorted(r["doc_id"] for r in kept["simhash"] if clean(r["text"]))
    assert sorted(r["doc_id"] for r in kept["decontamination"]) == expected
    assert len(expected) < len(kept["simhash"])


def test_the_mix_repeats_and_leaves_documents(kept):
    before = {tuple(r) for r in kept["decontamination"]}
    counts = collections.Counter(tuple(r) for r in kept["mixing"])
    assert set(counts) <= before and max(counts.values()) <= 3
    size = collections.Counter()
    for r in kept["decontamination"]:
        size[r["source"]] += len(r["text"].split())
    total = sum(size.values())
    taken = collections.Counter()
    for r in kept["mixing"]:
        taken[r["source"]] += len(r["text"].split())
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    capped: set = set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        share = {s: left * w / sum(v for o, v in weights.items() if o not in capped) for s, w in weights.items()}
        above = {s for s in weights if s not in capped and share[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    longest = max(len(r["text"].split()) for r in kept["decontamination"])
    for s in size:
        assert abs(taken[s] - (3 * size[s] if s in capped else share[s])) <= longest


def test_all_mixed_rows_get_a_place(kept):
    rows = kept["sharding"]
    mixed = collections.Counter(r["doc_id"] for r in kept["mixing"])
    assert collections.Counter(r["doc_id"] for r in rows) == mixed
    sizes = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 24)
    assert abs(sizes - sizes.mean()).max() <= max(r["size"] for r in rows) * 1.5
    for shard in range(24):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_run_gives_the_last_stage(spark, kept):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    ids = collections.Counter(r["doc_id"] for r in rows)
    assert ids == collections.Counter(r["doc_id"] for r in kept["sharding"])  # reruns agree
