"""Conversation prefix trie: succinct level-order tries over shared first turns.

A node is a distinct sequence of first turns (role, text); its key chains the
128-bit hashes of its turns, so a node has one key wherever it is built.

1. A conversation becomes a row of keys, one per prefix, and of its turns' sizes;
   texts go no further.  Rows with one last key are one path: their ids are joined
   in order, in pieces of at most CHUNK_IDS that a second task streams through
   SHA-256, so a conversation with any number of copies is never one row.
2. Prefixes of more than SHARD_PATHS distinct paths are the upper levels, found by
   one count of keys.  What hangs below them is dealt to shards by the hash of its
   first light prefix, so no first turn, however common, makes a large shard.
3. Each shard is one trie in LOUDS: a bit vector that writes, in level order, a one
   per child and a zero per node, and an array of labels in the same order.
4. Rollups read the bit vector back (ranks give parents) and add from the deepest
   level up with ``np.add.at``.  Nodes below the upper levels are final there; those
   of the upper levels come as parts, which one grouping by key merges.

A conversation is one row of 16-byte keys and must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, saved, sized, work_dir
from .textkernel import give_back

#: Distinct paths below one prefix from which it belongs to the upper levels; about as many make a shard
SHARD_PATHS = 1024
#: Ids that one row of a joined list holds
CHUNK_IDS = 8192
KEY_BYTES = 16
#: The key of the root, of which no turn is part
ROOT = bytes(KEY_BYTES)
_EMPTY = hashlib.sha256(b"").hexdigest()

PARTS = (
    "key binary, upper boolean, parent_key binary, ancestors array<binary>, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string"
)


def conversations_in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): labels and sizes of each conversation's turns, by turn.

    Null turns come first; turns that tie come by their labels; null roles and
    texts are empty; rows that repeat are turns of their own.  Rows without a
    conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the role's length keeps ("ab", "c") and ("a", "bc") apart
    label = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn"), label.alias("label"), F.octet_length(text).cast("long").alias("bytes"))
    ordered = F.array_sort(F.collect_list(turn))
    held = rows.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(ordered.alias("turns"))
    return held.select("conv_id", F.transform("turns", lambda t: F.struct(t["label"].alias("label"), t["bytes"].alias("bytes"))).alias("turns"))


def _chained(turns: Column) -> Column:
    """The key of every prefix, the root's first."""
    return F.aggregate(turns, F.array(F.lit(ROOT)), lambda done, t: F.concat(done, F.array(F.unhex(F.md5(F.concat(F.element_at(done, -1), t["label"]))))))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (key, conv_id) rows as (key, first, n, ids): at most CHUNK_IDS ids a row."""

    def row(key: bytes, ids: list[int]) -> tuple:
        return key, ids[0], len(ids), ",".join(map(str, ids))

    key, ids = None, []
    for batch in batches:
        out = []
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if (k != key or len(ids) >= CHUNK_IDS) and ids:
                out.append(row(key, ids))
                ids = []
            key = k
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "first", "n", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(key, ids), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "first", "n", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks of ids as (key, least, n, ends_sha256); one chunk is held at a time."""
    names, kinds = ["key", "least", "n", "ends_sha256"], (pa.binary(), pa.int64(), pa.int64(), pa.string())
    key, least, n, digest = None, 0, 0, None
    for batch in batches:
        out = []
        for k, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "first", "n", "ids"))):
            if k != key:
                if key is not None:
                    out.append((key, least, n, digest.hexdigest()))
                key, least, n, digest = k, first, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += count
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, least, n, digest.hexdigest()), kinds)], names=names)


def distinct_paths(conversations: DataFrame, folder: str) -> DataFrame:
    """(keys, sizes, n, least, ends_sha256): one row per distinct sequence of turns."""
    rows = conversations.select("conv_id", _chained(F.col("turns")).alias("keys"), F.col("turns.bytes").alias("sizes"))
    rows = saved(rows.withColumn("key", F.element_at("keys", -1)), f"{folder}/rows")
    by_id = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = mapped(by_id, _joined, "key binary, first long, n long, ids string")
    ends = mapped(chunks.repartition("key").sortWithinPartitions("key", "first"), _hashed, "key binary, least long, n long, ends_sha256 string")
    ends = saved(ends, f"{folder}/ends")
    # the row of the smallest id stands for all of its key
    return rows.join(ends.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("conv_id") == F.col("least"))).select("key", "keys", "sizes", "n", "least", "ends_sha256")


def in_shards(paths: DataFrame, folder: str, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """``paths`` with upper (the depth to which its prefixes are upper levels) and shard."""
    each = paths.select("key", F.posexplode("keys").alias("depth", "prefix"))
    upper = saved(each.groupBy("prefix").agg(F.count("*").alias("paths")).where(F.col("paths") > shard_paths).select("prefix"), f"{folder}/upper")
    deep = each.join(sized(upper, upper.count()), "prefix").groupBy(F.col("key").alias("k")).agg(F.max("depth").alias("deep"))
    held = paths.join(deep, F.col("key") == F.col("k"), "left").withColumn("upper", F.coalesce("deep", F.lit(0))).drop("deep", "k")
    shards = max(1, -(-paths.count() // shard_paths))
    first_light = F.element_at("keys", F.least(F.col("upper") + 2, F.size("keys")))
    return held.withColumn("shard", F.pmod(F.xxhash64(first_light), F.lit(shards)))


@dataclass
class Trie:
    """A shard's trie: nodes are numbered in level order, the root 0."""

    louds: np.ndarray  # bits: 1 0 for what stands above the root, then each node's children as ones and a zero
    labels: np.ndarray  # (n, 16) bytes: keys of the nodes

    @property
    def size(self) -> int:
        return len(self.labels)

    def parents(self) -> np.ndarray:
        """Zeros before a node's one, less one, are its parent's number; the root's is -1."""
        ones = np.flatnonzero(self.louds)
        return ones - np.arange(len(ones)) - 1

    def children(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.louds)
        return np.diff(zeros) - 1

    def levels(self) -> list[slice]:
        """The nodes of each depth."""
        child = np.cumsum(self.children()) + 1  # the first number after a node's children
        out, at, end = [], 0, 1
        while at < end:
            out.append(slice(at, end))
            at, end = end, int(child[end - 1])
        return out


def build(keys: list[np.ndarray]) -> tuple[Trie, list[np.ndarray]]:
    """The trie of some paths (each an (n, 16) array of prefix keys, the root's first), and each path's nodes by depth.

    The list has, per depth, the node of every path, -1 where it has ended.
    """
    length = np.array([len(k) for k in keys])
    first = np.concatenate([[0], np.cumsum(length)])
    flat = np.concatenate(keys) if keys else np.zeros((0, KEY_BYTES), np.uint8)
    words = np.ascontiguousarray(flat).view(np.uint64).reshape(-1, 2)
    at = np.zeros(len(keys), np.int64)
    places, labels, counts, n = [at], [flat[:1]], [], 1
    for depth in range(1, int(length.max(initial=1))):
        live = np.flatnonzero(length > depth)
        parent, word = places[-1][live], words[first[live] + depth]
        order = np.lexsort((word[:, 1], word[:, 0], parent))
        p, w = parent[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (p[1:] != p[:-1]) | (w[1:] != w[:-1]).any(axis=1)
        node = np.full(len(keys), -1, np.int64)
        node[live[order]] = n + np.cumsum(new) - 1
        above = int(n - len(labels[-1]))
        counts.append(np.bincount(p[new] - above, minlength=len(labels[-1])))
        labels.append(flat[first[live[order[new]]] + depth])
        places.append(node)
        n += int(new.sum())
    counts.append(np.zeros(len(labels[-1]), np.int64))
    children = np.concatenate(counts)
    louds = np.ones(2 * n + 1, bool)
    louds[1] = False
    louds[1 + np.cumsum(children + 1)] = False
    return Trie(louds, np.concatenate(labels)), places


def pack_shard(table: pa.Table) -> pa.Table:
    """A shard's paths as one row: the trie, and what its nodes hold before any rollup."""
    keys = [np.frombuffer(b"".join(k), np.uint8).reshape(-1, KEY_BYTES) for k in table.column("keys").to_pylist()]
    sizes = table.column("sizes").to_pylist()
    upper = np.array(table.column("upper").to_pylist(), np.int64)
    trie, places = build(keys)
    size, above = np.zeros(trie.size, np.int64), np.zeros(trie.size, bool)
    for depth, node in enumerate(places):
        live = np.flatnonzero(node >= 0)
        if depth:
            size[node[live]] = [sizes[k][depth - 1] for k in live.tolist()]
        above[node[live[upper[live] >= depth]]] = True
    last = np.array([places[len(k) - 1][i] for i, k in enumerate(keys)], np.int64)
    row = {
        "shard": table.column("shard")[0].as_py(), "n_nodes": trie.size, "louds": np.packbits(trie.louds).tobytes(), "labels": trie.labels.tobytes(), "sizes": size.astype("<i8").tobytes(),
        "upper": np.packbits(above).tobytes(), "ends": last.astype("<i8").tobytes(), "n": table.column("n").to_pylist(), "least": table.column("least").to_pylist(), "shas": table.column("ends_sha256").to_pylist(),
    }
    return pa.Table.from_pylist([row], schema=_SHARD)


_SHARD = pa.schema([("shard", pa.int64()), ("n_nodes", pa.int64()), *[(c, pa.binary()) for c in ("louds", "labels", "sizes", "upper", "ends")], ("n", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("shas", pa.list_(pa.string()))])
SHARDS = "shard long, n_nodes long, louds binary, labels binary, sizes binary, upper binary, ends binary, n array<long>, least array<long>, shas array<string>"


def opened(row: dict) -> Trie:
    """The trie of a row of SHARDS."""
    n = row["n_nodes"]
    return Trie(np.unpackbits(np.frombuffer(row["louds"], np.uint8), count=2 * n + 1).astype(bool), np.frombuffer(row["labels"], np.uint8).reshape(n, KEY_BYTES))


def rolled_up(row: dict) -> pa.RecordBatch:
    """Every node of a shard as a row of PARTS: final, or with ``upper`` a part of a node of the upper levels."""
    trie = opened(row)
    n = trie.size
    parent, children, levels = trie.parents(), trie.children(), trie.levels()
    size = np.frombuffer(row["sizes"], "<i8")
    upper = np.unpackbits(np.frombuffer(row["upper"], np.uint8), count=n).astype(bool)
    last = np.frombuffer(row["ends"], "<i8")
    convs, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(convs, last, np.array(row["n"], np.int64))
    np.minimum.at(least, last, np.array(row["least"], np.int64))
    leaves = (children == 0).astype(np.int64)
    leaves[upper] = 0
    for level in reversed(levels[1:]):
        np.add.at(convs, parent[level], convs[level])
        np.minimum.at(least, parent[level], least[level])
        np.add.at(leaves, parent[level], leaves[level])
    saved_here = (convs - ~upper) * size  # of an upper node its one copy is taken off where its parts meet
    for level in reversed(levels[1:]):
        np.add.at(saved_here, parent[level], saved_here[level])
    light = np.zeros(n, np.int64)
    np.add.at(light, parent[1:], ~upper[1:])
    depth = np.zeros(n, np.int64)
    for d, level in enumerate(levels):
        depth[level] = d
    key = [k.tobytes() for k in trie.labels]
    chains: list[list[bytes] | None] = [None] * n
    for i in np.flatnonzero(upper).tolist():
        chains[i] = [*(chains[parent[i]] if i else []), key[i]]
    sha: list[str | None] = [None] * n
    for i, s in zip(last.tolist(), row["shas"]):
        sha[i] = s
    below = (parent >= 0) & upper[np.maximum(parent, 0)]
    above = np.maximum(parent, 0)
    columns = [
        pa.array(key, pa.binary()), pa.array(upper), pa.array([key[p] if b else None for p, b in zip(parent.tolist(), below.tolist())], pa.binary()), pa.array(chains, pa.list_(pa.binary())), pa.array(least), pa.array(depth),
        pa.array(least[above], mask=below | (parent < 0)), pa.array(convs), pa.array(np.where(upper, light, children)), pa.array(leaves), pa.array(saved_here), pa.array(size), pa.array(sha, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PARTS.split(", ")])


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield rolled_up(row)
    give_back()


def prefix_tries(paths: DataFrame, folder: str, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The written tries, a row of SHARDS for each shard."""
    return saved(in_shards(paths, folder, shard_paths).groupBy("shard").applyInArrow(pack_shard, SHARDS), f"{folder}/tries")


def trie_nodes(tries: DataFrame, folder: str) -> DataFrame:
    """Per node of the whole trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = saved(mapped(tries, _roll, PARTS), f"{folder}/parts")
    up = parts.where("upper").groupBy("key").agg(
        F.first("ancestors").alias("ancestors"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_light"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_parts"), F.max("bytes").alias("bytes"), F.max("ends_sha256").alias("ends_sha256"),
    )
    up = saved(up, f"{folder}/up")
    # what each upper node takes off from, and adds to, those above it
    over = up.select(F.explode("ancestors").alias("key"), "bytes", F.size("ancestors").alias("size"), F.get("ancestors", F.size("ancestors") - 2).alias("above"))
    over = over.groupBy("key").agg(F.sum("bytes").alias("once"), F.count_if(F.col("above") == F.col("key")).alias("n_upper"))
    children = F.col("n_light") + F.col("n_upper")
    n_up = up.count()
    up = up.join(sized(over, n_up), "key").select(
        "key", F.get("ancestors", F.size("ancestors") - 2).alias("parent_key"), "conv_id", "depth", "n_convs", children.alias("n_children"),
        F.when(children == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("saved_parts") - F.col("once")).alias("saved_tokens"), "ends_sha256",
    )
    up = saved(up, f"{folder}/merged")
    named = up.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("named"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")]
    light = parts.where("not upper").join(sized(named, n_up), "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "named"))
    top = up.join(sized(named, n_up), "parent_key", "left").withColumn("parent_conv_id", F.col("named"))
    return light.select(*columns).unionByName(top.select(*columns))


def prefix_trie(conversations: DataFrame, folder: str | None = None, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The nodes of the trie over (conv_id, turns) rows; see :func:`trie_nodes`.

    A conversation without turns ends at the root.  An empty table has no nodes,
    not even the root.  Further columns are not read.  conv_ids do not repeat.
    """
    folder = folder or work_dir(conversations.sparkSession, "trie")
    paths = saved(distinct_paths(conversations, folder), f"{folder}/paths")
    return trie_nodes(prefix_tries(paths, folder, shard_paths), folder)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of c - c % 5, then its own after its first h."""
    own = conversations
    base = conversations.select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    both = own.join(base, F.col("base_id") == F.col("conv_id") - F.col("conv_id") % 5, "left")
    none = F.slice("turns", 1, 0)
    head = F.coalesce(F.slice("base", F.lit(1), h), none)
    return both.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "trie")
    rows = conversations_in_order(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(rebuilt(saved(rows, f"{folder}/turns")), folder)


#: crc32 of a number's decimal digits, byte by byte and bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP12_SQL = f"""
WITH l AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS label, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT conv_id, label, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, label) AS k FROM l),
h AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT h.conv_id, 0 AS part, t.k, t.label, t.bytes FROM h JOIN t ON t.conv_id = h.base AND t.k <= h.h
  UNION ALL SELECT h.conv_id, 1, t.k, t.label, t.bytes FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
m AS MATERIALIZED (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(label, '') OVER w AS prefix, bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)
  UNION ALL SELECT conv_id, 0, '', 0 FROM h),
e AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
n AS MATERIALIZED (
  SELECT prefix, any_value(m.depth) AS depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (e.depth = m.depth), '')) AS ends_sha256
  FROM m JOIN e USING (conv_id) GROUP BY prefix),
b AS (SELECT left(prefix, (32 * (depth - 1))::BIGINT) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
k AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN b USING (prefix)),
a AS (SELECT left(prefix, 32 * d) AS prefix, n_children, (n_convs - 1) * bytes AS kept FROM k, unnest(range(0, depth + 1)) AS u(d)),
s AS (SELECT prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(kept)::BIGINT AS saved_tokens FROM a GROUP BY prefix)
SELECT k.conv_id, k.depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (prefix) LEFT JOIN n q ON k.depth > 0 AND q.prefix = left(k.prefix, (32 * (k.depth - 1))::BIGINT)
"""
