"""The trie against all prefixes of all sequences; both batches; awkward turns."""

import collections
import hashlib
import random
import zlib

import duckdb
import pytest

import __spark_entry__ as registry
from compare import differences
from tillroll.llm import prefix_trie as pt
from tillroll.llm import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, at string"


def plain(seqs):
    """{sequence: result row without digest} from all prefixes; ``seqs``: {conv_id: [(turn, length), ...]}."""
    members = collections.defaultdict(list)
    for conv_id, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv_id)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, spared = collections.Counter(), collections.Counter()
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            spared[p[:d]] += (len(ids) - 1) * p[-1][1] if p else 0
    rows = {}
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(i for i in ids if len(seqs[i]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        rows[p] = (min(ids), len(p), parent, len(ids), children[p], leaves[p], spared[p], sha)
    return rows


def random_sequences(seed, n, alphabet, lengths):
    rng = random.Random(seed)
    seqs = {}
    for i in range(n):
        base = seqs[rng.randrange(i)] if i and rng.random() < 0.5 else []
        base = base[: rng.randrange(len(base) + 1)]
        seqs[i] = base + [(bytes([x := rng.randrange(alphabet)]), x + 1) for _ in range(rng.choice(lengths))]
    return seqs


@pytest.mark.parametrize("low, high", [(0, 1), (0, 5), (3, 4), (5, 12), (7, 8), (8, 100)])
def test_two_fattest(low, high):
    def twos(x):
        return x & -x

    assert pt.two_fattest(low, high) == max(range(low + 1, high + 1), key=twos)


@pytest.mark.parametrize("seed", range(20))
def test_insertion_and_expansion(seed):
    seqs = random_sequences(seed, 80, 1 + seed % 4, [0, 1, 2, 7, 30])
    trie = pt.ZFastTrie()
    for conv_id, turns in seqs.items():
        trie.insert(pt.running_digests(t for t, _ in turns), [n for _, n in turns], conv_id)
    got = sorted(tuple(row) for _, _, row in trie.expanded(trie.ended(), {}))
    assert got == sorted(plain(seqs).values(), key=lambda r: tuple(r))
    assert len(trie.handles) == len(trie.low) - 1  # every node but the root, each under its own handle


@pytest.mark.parametrize("share", [1, 4, 10**9])
def test_both_batches_give_the_same(spark, monkeypatch, share):
    """All, some or none of the conversations in the skeleton."""
    monkeypatch.setattr(pt, "SAMPLE_SHARE", share)
    monkeypatch.setattr(pt, "SAMPLE_TURNS", 3)
    monkeypatch.setattr(pt, "PIECE", 4)
    seqs = random_sequences(share, 200, 2, [0, 1, 2, 9])
    turn = "array<struct<digest: binary, length: int>>"
    df = spark.createDataFrame(list(seqs.items()), f"conv_id bigint, turns {turn}").repartition(5)
    got = [tuple(r) for r in pt.prefix_trie(df).collect()]
    assert sorted(got, key=str) == sorted(plain(seqs).values(), key=str)


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user", f"{c // 100}-{c % 3}-{t}") for c in (0, 7, 100, 101, 250, 251, 399) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: len(r["turns"]) for r in queries.rebuilt(df).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in got}
    assert got == {c: 8 if c - c % 100 in got else 8 - h[c] for c in got}


def test_awkward_turns_agree_with_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 12), 100, 107, 203, 305, -5, -100, None]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None, ""]), rng.choice([None, "", "a", "é😀", "b " * 5_000])))
    rows += [(8, t, "user", "hello") for t in range(300)] + [(108, t, "user", "hello") for t in range(300)]
    rows += rows[:6]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute("SET memory_limit = '4GB'")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op12_prefix_trie"
    assert differences(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name]) == []


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x", "", "")], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).collect() == []
