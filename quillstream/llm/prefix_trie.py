"""A trie of conversations by their turns, built from pieces that each fit a task.

A conversation is a path of turns, a turn the hash of its role and text; equal conversations become one path
first.  Paths are dealt by their first turn, and the pointer tries of a bucket are built in one pandas call: a
dictionary from turn to node for each node, filled from the root and summed up in post-order without recursion.
A first turn with too many paths is not built in one place: its paths' common prefix, from the smallest and the
largest of them, is a chain without branches, below which they are dealt anew by their next turn, and so on until
every piece is small.  Counts and the smallest id of a chain's nodes follow from its paths on the way down, its
leaves and sums from its pieces on the way up.

Defined results: a null role or text is empty; turns stand by number, null first, and turns of equal number by
their hash; repeated rows are turns of their own; rows without conv_id belong to no conversation; a conversation
without turns left ends at the root; an empty table has no node.  Other columns are ignored.  A conversation's
hashes are one row, so that one conversation, though no group of them, must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Workspace, partitions

BLOCK = 100  #: conversations that borrow their first turns from the same one
BORROWED = 6  #: they borrow fewer turns than this
MOST_TURNS, LEAST_TURNS = 500_000, 1_000  #: a node with more turns below it is oversized: a partition's share, within these bounds
CHUNK = 1 << 16  #: ids joined to one text
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (hash, chars) in order, of every conversation in turns(conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _sha(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    one = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("hash"), F.length(text).alias("chars")).alias("t"))
    by = one.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return by.select("conv_id", F.transform("t", lambda x: F.struct(x["hash"].alias("hash"), x["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, seq (hashes) and chars of each conversation after it has borrowed: its first h turns are those of the
    first conversation of its block, h the crc32 of its id modulo BORROWED; all of them if that has fewer, none if it is absent."""
    own = ws.save(conversations(turns), "conversations")
    head = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.slice("turns", 1, BORROWED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED).cast("int")
    both = own.join(head.hint("merge"), F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("block"), "left")
    empty = F.slice("turns", 1, 0)
    path = both.select("conv_id", F.concat(F.slice(F.coalesce("head", empty), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("t"))
    return path.select("conv_id", F.col("t.hash").alias("seq"), F.col("t.chars").alias("chars"))


def _ends(ids: DataFrame) -> DataFrame:
    """key, ends: SHA-256 of each key's ids in order, joined by commas.

    Sorted over many tasks, each of which joins its ids to long texts; a key's texts then run through one hash, so
    that even a key with a third of all ids is a few rows there and is never held."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("low", pa.int64()), ("text", pa.binary())])
        key, low, held, out = None, None, [], []
        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (k != key or len(held) >= CHUNK):
                    out.append((key, low, ",".join(held).encode()))
                    held = []
                if not held:
                    key, low = k, i
                held.append(str(i))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], schema.field(c).type) for c in range(3)], schema=schema)
            out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((key, low, ",".join(held).encode()), schema)], schema=schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, keys, out = None, None, [], []
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    state.update(b"," + text)
                    continue
                if state is not None:
                    keys.append(key), out.append(state.hexdigest())
                key, state = k, hashlib.sha256(text)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends": pa.array(out, pa.string())})
            keys, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": pa.array([state.hexdigest()], pa.string())})

    n = partitions(ids.sparkSession)
    texts = ids.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined, "key binary, low long, text binary")
    return texts.repartition(n, "key").sortWithinPartitions("key", "low").select("key", "text").mapInArrow(hashed, "key binary, ends string")


def classes(paths: DataFrame, ws: Workspace) -> DataFrame:
    """seq, chars, first (smallest id), n and ends of each distinct path."""
    key = F.aggregate("seq", F.lit(b""), lambda a, x: _sha(F.concat(a, x)))
    keyed = ws.save(paths.withColumn("key", key), "paths")
    alike = keyed.groupBy("key").agg(F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return alike.join(_ends(keyed.select("key", "conv_id")).hint("merge"), "key").drop("key")


def _tries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The tries of one bucket: a row for each node, with the group that a top node stands for."""
    top: dict[bytes, int] = {}
    below: list[dict[bytes, int]] = []
    up, depth, last, first, count, ends, group = [], [], [], [], [], [], []

    def node(parent: int, at: int, chars: int, gid: bytes | None) -> int:
        for column, value in ((below, {}), (up, parent), (depth, at), (last, chars), (first, None), (count, 0), (ends, NOTHING), (group, gid)):
            column.append(value)
        return len(up) - 1

    above: dict[bytes, tuple[bytes, int]] = {}
    for gid, parent, over, at, seq, chars, low, n, end in zip(*(pdf[c].tolist() for c in ("gid", "parent", "over", "depth", "seq", "chars", "first", "n", "ends"))):
        here = top.get(gid)
        if here is None:
            here = top[gid] = node(-1, at, int(chars[at - 1]), gid)
            above[gid] = parent, over
        for k in range(at, len(seq) + 1):
            first[here] = low if first[here] is None else min(first[here], low)
            count[here] += n
            if k == len(seq):
                break
            turn = bytes(seq[k])
            after = below[here].get(turn)
            if after is None:
                after = below[here][turn] = node(here, k + 1, int(chars[k]), None)
            here = after
        ends[here] = end
    leaves, saved = [0] * len(up), [(n - 1) * c for n, c in zip(count, last)]
    for i in range(len(up) - 1, -1, -1):  # a node comes after the one above it: backwards is a post-order
        leaves[i] = leaves[i] or 1
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    over = [first[p] if g is None else above[g][1] for p, g in zip(up, group)]
    parents = [None if g is None else above[g][0] for g in group]
    return pd.DataFrame({"conv_id": first, "depth": depth, "parent_conv_id": over, "n_convs": count, "n_children": [len(b) for b in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "gid": group, "parent": parents})


def prefix_trie(paths: DataFrame, ws: Workspace, least_turns: int = LEAST_TURNS) -> DataFrame:
    """One row for each node of the trie of paths(conv_id, seq, chars), the root included; see NODE for the columns.

    conv_id: the smallest member's; parent_conv_id: its parent node's; n_convs: members; n_leaves: childless nodes of
    the subtree; saved_tokens: over the subtree, what members after the first need not repeat of a node's last turn."""
    spark = paths.sparkSession
    own = ws.save(classes(paths, ws), "classes")
    total = own.agg(F.sum(F.size("seq")).alias("turns"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max(F.when(F.size("seq") == 0, F.col("ends"))).alias("ends")).first()
    if total["n"] is None:
        return spark.createDataFrame([], NODE)
    share = total["turns"] // partitions(spark)
    limit = min(MOST_TURNS, max(least_turns, share))
    buckets = max(4 * partitions(spark), total["turns"] // limit)

    # down: the root, then every oversized node, is parted by the next turn
    gid = lambda over, at: _sha(F.concat(over, F.get("seq", at)))
    root = F.lit(b"root")
    cur = own.filter(F.size("seq") > 0).select(gid(root, F.lit(0)).alias("gid"), root.alias("parent"), F.lit(total["first"]).cast("long").alias("over"), F.lit(1).alias("depth"), "seq", "chars", "first", "n", "ends")
    small, chains = [], []
    while True:
        weight = cur.groupBy("gid").agg(F.sum(F.size("seq") - F.col("depth") + 1).alias("turns"), F.count(F.lit(1)).alias("paths"))
        big = ws.save(weight.filter((F.col("turns") > limit) & (F.col("paths") > 1)).select("gid"), "oversized")
        if big.isEmpty():
            small.append(cur)
            break
        small.append(cur.join(big, "gid", "left_anti"))
        parted = cur.join(big, "gid")
        stem = parted.groupBy("gid", "parent", "over", "depth").agg(
            F.min(F.struct("seq", "chars", "ends")).alias("a"), F.max("seq").alias("b"), F.min("first").alias("first"), F.sum("n").alias("n")
        )
        # the smallest and the largest path agree on what all have in common
        same = F.array_position(F.zip_with(F.col("a.seq"), F.col("b"), lambda x, y: x.eqNullSafe(y)), False).cast("int") - 1
        common = F.when(same < 0, F.size("a.seq")).otherwise(F.least(same, F.size("a.seq")))
        stem = stem.select("gid", "parent", "over", "depth", "first", "n", common.alias("common"), F.slice("a.chars", F.col("depth"), common - F.col("depth") + 1).alias("chars"), F.when(F.size("a.seq") == common, F.col("a.ends")).otherwise(NOTHING).alias("ends"))
        stem = ws.save(stem, "stems")
        chains.append(stem)
        under = parted.drop("over", "depth", "parent").join(stem.select("gid", "common", F.col("first").alias("over")), "gid").filter(F.size("seq") > F.col("common"))
        cur = ws.save(under.select(gid(F.col("gid"), F.col("common")).alias("gid"), F.col("gid").alias("parent"), "over", (F.col("common") + 1).alias("depth"), "seq", "chars", "first", "n", "ends"), "parted")

    pieces = small[0]
    for s in small[1:]:
        pieces = pieces.unionByName(s)
    bucket = F.pmod(F.xxhash64("gid"), F.lit(buckets))
    built = ws.save(pieces.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_tries, f"{NODE}, gid binary, parent binary"), "nodes")

    # up: leaves and sums of the tops, from the pieces to the stems above them
    tops = built.filter("gid IS NOT NULL").select("gid", "n_leaves", "saved_tokens", "parent")
    out = built.drop("gid", "parent")
    for stem in reversed(chains):
        sums = tops.groupBy(F.col("parent").alias("gid")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"))
        saved = lambda k: F.col("under") + (F.col("n") - 1) * F.aggregate(F.slice("chars", k, F.size("chars")), F.lit(0).cast("long"), lambda a, x: a + x)
        known = ws.save(stem.join(sums, "gid"), "summed")
        nodes = known.select("*", F.posexplode("chars").alias("at", "_"))
        final = F.col("at") == F.size("chars") - 1
        out = out.unionByName(nodes.select(
            F.col("first").alias("conv_id"), (F.col("depth") + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("over")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(final, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved(F.col("at") + 1).alias("saved_tokens"), F.when(final, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
        ))
        tops = tops.unionByName(known.select("gid", "n_leaves", saved(F.lit(1)).alias("saved_tokens"), "parent"))
    at_root = tops.filter(F.col("parent") == root).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return out.unionByName(at_root.select(
        F.lit(total["first"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).cast("long").alias("n_convs"),
        "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.lit(total["ends"] or NOTHING).alias("ends_sha256"),
    ))
