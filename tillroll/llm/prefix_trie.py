"""Prefix trie of conversations: which turns they share from the start, and what a cache of those turns would save.

A node of the trie is a distinct sequence of first turns. Sequences are compared by a running 128-bit digest: the digest
at depth d is made of the digest at d - 1 and the d-th turn, so equal digests mean equal sequences.

``ZFastTrie`` holds compacted nodes: a node stands for all depths of its edge, from below its parent down to where
sequences part or one ends. Each is filed in a hash table under its handle, the digest at the two-fattest depth of its
edge (the depth divisible by the largest power of two). Where a sequence leaves the trie is found by fat binary search:
at most log2(length) looks into that table instead of a walk from the root.

On Spark the conversations are inserted in two batches. The first, a sample of bounded size, becomes the skeleton, which
every task gets. A task locates the exit of each of its conversations in the skeleton: either the conversation ends there
and only counts, or it goes on into a region of its own, named by its digest one turn below. All of a region meets in one
task, where the second batch is inserted into a trie of that region alone, whose edges are expanded into rows of the
result. Sums over regions, grouped by where they hang, then complete the skeleton. A start that many conversations share
is in the sample, and so in the skeleton: its conversations are dealt out by what follows it. A region therefore holds
some N / sample conversations, whatever is shared. Nothing is approximate: the sample only decides where rows meet.
What must fit in a task is one conversation: 20 bytes for each of its turns, not its texts.

The lists of conversations that end at a node of the skeleton may be long. SHA-256 wants them in order: ids are sorted by
range, each task makes pieces of some 100,000 ids, and only the pieces of a node pass one task, as a stream.

Defined cases: rows without a conversation id belong to none and are left out. A null role or text is empty. Turns follow
by number, null first; equal numbers by digest (MD5 of the role's bytes counted, a colon, role and text). Repeated rows are turns of their own. A conversation
without turns ends at the root. An empty table has no nodes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tillroll.llm.common import saved

# the first batch: one conversation in so many, at most so many of them, of each at most so many turns
SAMPLE_SHARE = 16
SAMPLE = 1 << 15
SAMPLE_TURNS = 4_096
# conversation ids in a piece of a list that is hashed
PIECE = 100_000
# rows of the result that a task hands over at a time
BATCH = 10_000
DIGEST = 16
ROOT = b""

RESULT = {
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
}
NO_ENDS = hashlib.sha256(b"").hexdigest()


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that is divisible by the largest power of two."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def running_digests(turns: Iterable[bytes]) -> list[bytes]:
    """One digest for each depth of a sequence of turns."""
    out, last = [], ROOT
    for turn in turns:
        last = hashlib.md5(last + turn).digest()
        out.append(last)
    return out


class ZFastTrie:
    """Compacted trie of sequences that share everything up to depth ``top``, given by their digests below it.

    Nodes are numbers, the root is 0. Node i covers the depths ``low[i]`` + 1 to ``high(i)``; ``path[i]`` and
    ``lengths[i]`` hold the digest and the text length of each of them.
    """

    def __init__(self, top: int = 0):
        self.top = top
        self.low: list[int] = [top]
        self.path: list[list[bytes]] = [[]]
        self.lengths: list[list[int]] = [[]]
        self.children: list[dict[bytes, int]] = [{}]  # by the digest one turn below the node
        self.ends: list[list[int]] = [[]]  # conversations that end at the node's last depth
        self.handles: dict[bytes, int] = {}

    def high(self, node: int) -> int:
        return self.low[node] + len(self.path[node])

    def _handle(self, node: int) -> bytes:
        return self.path[node][two_fattest(self.low[node], self.high(node)) - self.low[node] - 1]

    def _add(self, low: int, path: list[bytes], lengths: list[int], children: dict[bytes, int], ends: list[int]) -> int:
        for column, value in zip(
            (self.low, self.path, self.lengths, self.children, self.ends), (low, path, lengths, children, ends)
        ):
            column.append(value)
        node = len(self.low) - 1
        self.handles[self._handle(node)] = node
        return node

    def locate(self, path: list[bytes]) -> tuple[int, int]:
        """The exit: the node on whose edge the sequence leaves the trie, and the last depth at which both agree."""
        end = self.top + len(path)
        low, high, last = self.top, end, 0
        while low < high:
            fat = two_fattest(low, high)
            node = self.handles.get(path[fat - self.top - 1])
            if node is None:
                high = fat - 1
            elif self.high(node) <= end and self.path[node][-1] == path[self.high(node) - self.top - 1]:
                low, last = self.high(node), node  # all of this edge agrees
            else:
                return node, self._agreed(node, path, fat)  # the sequence leaves below the handle
        if low < end and (below := self.children[last].get(path[low - self.top])) is not None:
            return below, self._agreed(below, path, low + 1)
        return last, low

    def _agreed(self, node: int, path: list[bytes], known: int) -> int:
        """The last depth of the node's edge at which the sequence agrees with it, by halving; it does so at ``known``."""
        low, high = known, min(self.high(node), self.top + len(path))
        while low < high:
            middle = (low + high + 1) // 2
            if self.path[node][middle - self.low[node] - 1] == path[middle - self.top - 1]:
                low = middle
            else:
                high = middle - 1
        return low

    def insert(self, path: list[bytes], lengths: list[int], conv_id: int) -> None:
        node, depth = self.locate(path)
        if depth < self.high(node):
            self._split(node, depth)
        if depth < self.top + len(path):
            rest = depth - self.top
            self.children[node][path[rest]] = node = self._add(depth, path[rest:], lengths[rest:], {}, [])
        self.ends[node].append(conv_id)

    def _split(self, node: int, depth: int) -> None:
        """Ends the node's edge at ``depth``; what lies below becomes a node of its own. Both get new handles."""
        del self.handles[self._handle(node)]
        cut = depth - self.low[node]
        path, lengths = self.path[node], self.lengths[node]
        lower = self._add(depth, path[cut:], lengths[cut:], self.children[node], self.ends[node])
        self.path[node], self.lengths[node] = path[:cut], lengths[:cut]
        self.children[node], self.ends[node] = {path[cut]: lower}, []
        self.handles[self._handle(node)] = node

    def ended(self) -> dict[bytes, tuple[int, int, str]]:
        """Digest -> number, least, and hash of the sorted list of the conversations that end there."""
        out = {}
        for node, ids in enumerate(self.ends):
            if ids:
                text = ",".join(map(str, sorted(ids)))
                digest = self.path[node][-1] if self.path[node] else ROOT
                out[digest] = (len(ids), min(ids), hashlib.sha256(text.encode()).hexdigest())
        return out

    def expanded(
        self, ended: dict[bytes, tuple[int, int, str]], hanging: dict[bytes, tuple[int, int, int, int, int]]
    ) -> list[tuple[bytes, int, list]]:
        """Every depth of every edge: (digest, node, [the columns of ``RESULT``]); the edge nearest the root first.

        ``ended`` has the conversations that end at a digest (number, least, hash), ``hanging`` sums over what hangs
        there besides this trie's own nodes (conversations, least, leaves, saved tokens, children).
        """
        parents_first = [0]
        for node in parents_first:
            parents_first += self.children[node].values()
        out: list[tuple[bytes, int, list]] = []
        top_row: dict[int, list] = {}
        for node in reversed(parents_first):
            below = [top_row[child] for child in self.children[node].values()]
            steps = list(zip(self.path[node], self.lengths[node])) or [(ROOT, 0)]
            for i in range(len(steps) - 1, -1, -1):
                digest, length = steps[i]
                count, least, listed = ended.get(digest, (0, None, NO_ENDS))
                leaves = saved_tokens = children = 0
                if digest in hanging:
                    n, first, leaves, saved_tokens, children = hanging[digest]
                    count, least = count + n, first if least is None else min(least, first)
                for row in below:
                    count, least = count + row[3], row[0] if least is None else min(least, row[0])
                    leaves, saved_tokens = leaves + row[5], saved_tokens + row[6]
                children += len(below)
                saved_tokens += (count - 1) * length
                depth = self.low[node] + i + 1 if self.path[node] else self.top
                row = [least, depth, None, count, children, leaves if children else 1, saved_tokens, listed]
                for child in below:
                    child[2] = least
                out.append((digest, node, row))
                below = [row]
            top_row[node] = below[0]
        return out[::-1]


def sequences(conversations: DataFrame, *keys: str) -> DataFrame:
    """(keys, conv_id, turns): the turns of every conversation in order, each as digest and number of code points.

    Only digests are shuffled. With ``keys`` (functions of the conversation) rows are dealt by them, so that what
    is done by key afterwards finds its rows in place.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        *keys, "conv_id", "turn", digest.alias("digest"), F.length(text).alias("length")
    )
    if keys:
        rows = rows.repartition(*keys)
    listed = F.sort_array(F.collect_list(F.struct("turn", "digest", "length")))
    turns = F.transform(listed, lambda t: F.struct(t["digest"].alias("digest"), t["length"].alias("length")))
    return rows.groupBy(*keys, "conv_id").agg(turns.alias("turns"))


def _conversations(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(id, running digests, text lengths) of every row."""
    turns = batch.column("turns")
    offsets = turns.offsets.to_pylist()
    fields = turns.values
    digests, lengths = fields.field("digest").to_pylist(), fields.field("length").to_pylist()
    for conv_id, start, end in zip(batch.column("conv_id").to_pylist(), offsets, offsets[1:]):
        yield conv_id, running_digests(digests[start:end]), lengths[start:end]


def skeleton(seqs: DataFrame) -> ZFastTrie:
    """The trie of the first batch: a sample of bounded size, by hash of the conversation's id."""
    key = F.xxhash64("conv_id")
    chosen = seqs.filter(F.pmod(key, F.lit(SAMPLE_SHARE)) == 0).orderBy(key, "conv_id").limit(SAMPLE)
    trie = ZFastTrie()
    for batch in chosen.select("conv_id", F.slice("turns", 1, SAMPLE_TURNS).alias("turns")).toArrow().to_batches():
        for conv_id, path, lengths in _conversations(batch):
            trie.insert(path, lengths, conv_id)
    # what ends where is counted for all conversations alike, later
    trie.ends = [[] for _ in trie.ends]
    return trie


def _located(seqs: DataFrame, trie: ZFastTrie) -> DataFrame:
    """Each conversation's exit ``at`` the skeleton; ``region`` (null: it ends there) and what lies below the exit."""
    shared = seqs.sparkSession.sparkContext.broadcast(trie)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for conv_id, path, lengths in _conversations(batch):
                _, depth = known.locate(path)
                at, below = path[depth - 1] if depth else ROOT, path[depth:]
                rows.append((conv_id, at, depth, below[0] if below else None, b"".join(below), lengths[depth:]))
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
            columns = zip(*rows) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds)],
                ["conv_id", "at", "depth", "region", "path", "lengths"],
            )

    schema = "conv_id long, at binary, depth int, region binary, path binary, lengths array<int>"
    return seqs.select("conv_id", "turns").mapInArrow(locate, schema)


def _regions(located: DataFrame) -> DataFrame:
    """The nodes of all regions; the topmost of each has its exit ``at`` the skeleton, and no parent yet."""
    kinds = {"at": pa.binary(), **RESULT}

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in batch.schema.names]))
        ready: list = []
        for _, region in groupby(rows, key=lambda row: row[0]):
            trie = None
            for _, at, depth, conv_id, path, lengths in region:
                trie = trie or ZFastTrie(depth)
                trie.insert([path[i : i + DIGEST] for i in range(0, len(path), DIGEST)], lengths, conv_id)
            for _, node, row in trie.expanded(trie.ended(), {}):
                if not node:  # the region's root is the skeleton's
                    continue
                topmost = row[1] == depth + 1
                if topmost:
                    row[2] = None
                ready.append((at if topmost else None, *row))
            if len(ready) >= BATCH:
                yield batch_of(ready)
                ready = []
        if ready:
            yield batch_of(ready)

    schema = (
        "at binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
        " saved_tokens long, ends_sha256 string"
    )
    rows = located.filter(F.col("region").isNotNull()).select("region", "at", "depth", "conv_id", "path", "lengths")
    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(build, schema)


def _ended(located: DataFrame) -> DataFrame:
    """(at, n, least, sha256) of the conversations that end at each digest of the skeleton."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ("at", "conv_id")]))
        for at, group in groupby(rows, key=lambda row: row[0]):
            ids: list[int] = []
            for _, conv_id in group:
                ids.append(conv_id)
                if len(ids) == PIECE:
                    yield piece(at, ids)
                    ids = []
            if ids:
                yield piece(at, ids)

    def piece(at: bytes, ids: list[int]) -> pa.RecordBatch:
        columns = {"at": [at], "least": [ids[0]], "n": [len(ids)], "ids": [",".join(map(str, ids))]}
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(c).to_pylist() for c in ("at", "least", "n", "ids")]))
        for at, group in groupby(rows, key=lambda row: row[0]):
            digest, n, first = hashlib.sha256(), 0, None
            for _, least, count, ids in group:
                digest.update((("," if n else "") + ids).encode())
                n, first = n + count, least if first is None else first
            columns = {"at": ([at], pa.binary()), "n": ([n], pa.int64()), "least": ([first], pa.int64())}
            columns["sha256"] = ([digest.hexdigest()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], list(columns))

    rows = located.filter(F.col("region").isNull()).select("at", "conv_id")
    rows = rows.repartitionByRange("at", "conv_id").sortWithinPartitions("at", "conv_id")
    parts = rows.mapInArrow(pieces, "at binary, least long, n long, ids string")
    ordered = parts.repartition("at").sortWithinPartitions("at", "least")
    return ordered.mapInArrow(hashed, "at binary, n long, least long, sha256 string")


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """One row per node: smallest member, depth, parent's smallest member, members, children, leaves and saved tokens of
    its subtree, and the hash of the list of members that end there. ``seqs``: (conv_id, turns) as ``sequences`` gives.

    Saved tokens are counted as code points: all but one of a node's members find its last text in the cache.
    """
    spark = seqs.sparkSession
    seqs = saved(seqs.select("conv_id", "turns"), "sequences")
    trie = skeleton(seqs)
    located = saved(_located(seqs, trie), "located")
    regions = saved(_regions(located), "regions")
    # both at most a row for each depth of the sampled conversations
    ended = {r["at"]: (r["n"], r["least"], r["sha256"]) for r in _ended(located).toArrow().to_pylist()}
    sums = regions.filter(F.col("at").isNotNull()).groupBy("at")
    sums = sums.agg(F.sum("n_convs"), F.min("conv_id"), F.sum("n_leaves"), F.sum("saved_tokens"), F.count(F.lit(1)))
    hanging = {at: tuple(rest) for at, *rest in (r.values() for r in sums.toArrow().to_pylist())}
    inner = [(digest, *row) for digest, _, row in trie.expanded(ended, hanging) if row[3]]

    names = ["digest", *RESULT]
    columns = list(zip(*inner)) if inner else [[] for _ in names]
    table = pa.table([pa.array(list(c), k) for c, k in zip(columns, [pa.binary(), *RESULT.values()])], names=names)
    top = spark.createDataFrame(table)
    parents = F.broadcast(top.select(F.col("digest").alias("at"), F.col("conv_id").alias("_parent")))
    parent = F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id")
    below = regions.join(parents, "at", "left").select(*[parent if c == "parent_conv_id" else F.col(c) for c in RESULT])
    return top.select(*RESULT).unionAll(below)
