"""Registered queries against their SQL, or against brute force where SQL cannot express them."""

import collections
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as registry
from compare import differences, duck
from rows import awkward, documents, prose
from tillroll.llm import decontamination, mixing, quality_rules, queries, simhash, substring_dedup

SF_DIR = "/root/testdata/sf0.001"
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_all_operators_and_the_pipeline_are_registered():
    numbers = {int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries()}
    assert numbers == set(range(1, 14))
    assert "pipeline" in registry.queries()
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(registry.queries()[name](spark, SF_DIR), con, registry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", ["op7_quality_rules", "op8_substring_dedup"])
def test_awkward_documents_agree_with_sql(spark, tmp_path, name):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert differences(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) == []


def test_awkward_benchmark_agrees_with_sql(spark, tmp_path):
    documents(spark).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, prose(2, 60)), (2, "one two three"), (None, prose(2, 60)), (None, "Two, three"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    bench.coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    name = "op2_decontamination"
    assert differences(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) == []
    rows = {r["doc_id"]: r["n_items"] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert rows[7] == rows[11] == 2


def test_mix_meets_its_targets(spark):
    rows = [tuple(r) for r in queries.op1_mixing(spark, SF_DIR).collect()]
    docs = registry.queries()["op1_mixing"](spark, SF_DIR)
    assert sorted(rows) == sorted(tuple(r) for r in docs.collect())  # reruns agree
    by_source = collections.defaultdict(list)
    for doc_id, size, source_size, target, taken, source, copies in rows:
        assert taken == copies * size and 0 <= copies <= 3
        by_source[source].append((size, source_size, target, taken))
    total = sum(x[0][1] for x in by_source.values())
    # shares by hand: what is above three times a source's size goes to the others, until nothing is
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(by_source, key=lambda s: (s is None, s)))}
    capped: set = set()
    while True:
        left = total - sum(3 * by_source[s][0][1] for s in capped)
        open_ = {s: w for s, w in weights.items() if s not in capped}
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        above = {s for s in share if share[s] > 3 * by_source[s][0][1]}
        if not above:
            break
        capped |= above
    for s, x in by_source.items():
        assert x[0][1] == sum(y[0] for y in x)
        assert x[0][2] == pytest.approx(share.get(s, 3 * x[0][1]))
        assert abs(sum(y[3] for y in x) - x[0][2]) <= max(y[0] for y in x)


def test_a_chunk_hands_on_one_fraction_and_all_words():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    n = 500
    table = pa.table(
        {
            "size": rng.integers(1, 50, n),
            "part": rng.random(n),
            "unit": np.arange(n),
            "draw": rng.random(n),
            "coin": rng.random(n),
        }
    )
    out = mixing._reduce(table)
    part, size = out["part"].to_numpy(), out["size"].to_numpy()
    assert ((part > 0) & (part < 1)).sum() <= 1
    assert (part * size).sum() == pytest.approx((table["part"].to_numpy() * size).sum(), abs=1e-3)


def test_expectation_of_a_pair_is_kept():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    taken = np.zeros(2)
    for _ in range(4000):
        draws = {"draw": rng.random(2), "coin": rng.random(2)}
        table = pa.table({"size": [10, 5], "part": [0.3, 0.4], "unit": [0, 1], **draws})
        taken += mixing._reduce(table)["part"].to_numpy()
    assert taken / 4000 == pytest.approx([0.3, 0.4], abs=0.03)


def brute_print(text):
    words = BLANKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_brute_force(prints, radius=4):
    fps = np.array(sorted({f for _, f in prints}), np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    at = {int(f): root(i) for i, f in enumerate(fps)}
    smallest: dict = {}
    for doc_id, f in prints:
        if doc_id is not None:
            smallest[at[f]] = min(smallest.get(at[f], doc_id), doc_id)
    return sorted(((d, f"{f:016x}", smallest.get(at[f])) for d, f in prints), key=str)


def test_simhash_agrees_with_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    prints = [(r["doc_id"], brute_print(r["text"])) for r in docs]
    got = sorted((tuple(r) for r in queries.op4_simhash(spark, SF_DIR).collect()), key=str)
    assert got == groups_by_brute_force(prints)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_near_links_of_chains_and_crowds(spark, chunk):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 60, dtype=np.int64).view(np.uint64)
    fps = [centre]
    for _ in range(4):
        flips = np.zeros(60, np.uint64)
        for _ in range(3):
            flips |= np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)
        fps.append(fps[-1] ^ flips)
    crowd = centre[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.unique(np.concatenate([*fps, crowd]))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    links = simhash.near_links(frame, 4, chunk)
    from tillroll.llm.components import components

    roots = {r["node"]: r["root"] for r in components(links).collect()}
    got = sorted((int(np.uint64(f)), roots.get(int(f.view(np.int64)), int(f.view(np.int64)))) for f in fps)
    names: dict = {}
    got = [(f, names.setdefault(r, f)) for f, r in got]
    expected = groups_by_brute_force([(int(f), int(f)) for f in fps])
    assert sorted((str(a), b) for a, b in got) == sorted((str(d), c) for d, _, c in expected)


@pytest.mark.parametrize("radius", [0, 1])
def test_near_links_within_a_small_radius(spark, radius):
    fps = [5, 4, 6, 1 << 40, (1 << 40) + 3, 3 << 40]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), radius)
    got = {frozenset(row) for row in links.collect()}
    assert got == ({frozenset(p) for p in [(5, 4), (4, 6), (1 << 40, 3 << 40)]} if radius else set())


def test_shards_are_even_whole_and_gapless(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = queries.op5_sharding(spark, SF_DIR).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(r["doc_id"] for r in docs.collect())
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    assert total == docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0]
    for shard in range(24):
        own = [r for r in rows if r["shard"] == shard]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 24) <= largest + 0.02 * total / 24


def test_hot_keys_are_split(spark):
    from tillroll.llm.sharding import assign_shards

    rows = spark.range(3000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.lit(7).alias("size"))
    out = assign_shards(rows, [F.col("k")], F.col("size"), 10, ranges=40)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(counts) == 10 and max(counts) - min(counts) <= 2


def test_windows_in_blocks_give_the_same(spark):
    docs, bench = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontamination.find_spans(docs.select("doc_id", "text"), bench, keep_text=False)
    blocks = decontamination.find_spans(docs.select("doc_id", "text"), bench, keep_text=False, block_words=400)
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))


def test_cut_texts_hold_no_window(spark):
    docs, bench = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontamination.find_spans(docs, bench)
    assert found.filter(F.size("spans") > 0).count() > 0
    cut = decontamination.without_spans(found)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    again = decontamination.find_spans(cut, bench)
    # cutting joins what stood around a span; such new windows are rare, and a second pass would find them
    assert again.filter(F.size("spans") > 0).count() <= 1


def test_hot_anchors_give_the_same(spark):
    rows = [(i, r[1], None, None, None, None, None, None) for i, r in enumerate(awkward())]
    docs = documents(spark, rows * 3 + [(99, prose(2, 60) + " end", None, None, None, None, None, None)])
    whole = substring_dedup.without_repeats(docs)
    windows = substring_dedup.without_repeats(docs, hot=1)
    assert sorted(map(str, whole.collect())) == sorted(map(str, windows.collect()))


def test_held_out_languages_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_ablation_counts(spark):
    rows = quality_rules.ledger(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    found = {r["rule"]: (r["failing"], r["only_this"]) for r in quality_rules.ablation(rows, "v1").collect()}
    failed = [r["failed"] for r in rows.collect()]
    for rule in quality_rules.RULES:
        bit = 1 << rule.bit
        expected = (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed))
        assert found.get(rule.name, (0, 0)) == expected


def test_toxic_and_low_documents_are_caught(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("toxic", "label")
    rows = queries.op6_site_quality(spark, sf_dir).join(labels, "doc_id")
    shares = rows.agg(
        F.avg(F.when(F.col("label") == 1, F.col("is_toxic").cast("int"))).alias("toxic"),
        F.avg(F.when(F.col("quality") == 0, F.col("is_low").cast("int"))).alias("low"),
        F.avg(F.when((F.col("label") == 0) & (F.col("quality") == 1), F.col("kept").cast("int"))).alias("kept"),
    ).first()
    assert shares["toxic"] > 0.95 and shares["low"] > 0.9 and shares["kept"] > 0.95
