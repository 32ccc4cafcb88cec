"""All repeated windows of a fixed length in a corpus, exactly, from a sparse set of sampled suffixes.

A window is `length` consecutive symbols of one row.  Each window start is owned by one sampled position of
its own window: the smallest hashed k-gram among its first `sample` positions.  That choice depends on the
window alone, so equal windows are owned at equal distances, and a run of starts with one owner is a tuple
(first start, last start, owner).  For each tuple hashes stand in for sorted order:

    core   of the symbols common to all windows that the owner can own there (its common prefix),
    span   of the symbols from the first start to the end of the last window,
    check  of the same symbols, by another base and other codes.

Two tuples count as equal only where span and check agree, 128 bits together.

Sorting (hash-partitioned, spilling to disk, combined before the shuffle) by core gives three outcomes:
a core that occurs once: no window of the tuple repeats; all tuples of a core with one span: every window
repeats; several spans: the group branches.  In branching groups spans that occur twice are settled, and one
tuple of each span, with its multiplicity, is cut into shorter ranges of starts and goes into the next
round.  In the last round a range is one window.  So the work after the first round is on the borders of
repeats only, and no group's rows ever meet in one task other than as sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Prefix, blocks, mix
from .frames import Workspace

SEGMENT = 1 << 20
_POS = np.uint64((1 << 24) - 1)
TUPLE = "body long, s int, e int, owner int, core long, span long, check long"
NAMES = ["doc_id", "body", "s", "e", "owner", "core", "span", "check"]


@dataclass(frozen=True)
class Shape:
    """length of a window, sample width, k-gram that samples are drawn by, and the cuts of later rounds."""

    length: int
    sample: int
    gram: int
    cuts: tuple[int, ...]


Codes = Callable[["object"], list[np.ndarray]]  # a block's rows as arrays of symbol codes


def sampled(codes: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """s, e, owner, core, span and check of a row's tuples, taken in segments so that memory follows SEGMENT."""
    n = len(codes) - shape.length + 1
    parts = [_segment(codes[t : t + SEGMENT + shape.length - 1], shape, t) for t in range(0, max(n, 0), SEGMENT)]
    if not parts:
        # of the same types as others': numpy joins signed and unsigned to floats, which round hashes
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment(codes: np.ndarray, shape: Shape, at: int) -> tuple[np.ndarray, ...]:
    m, w = len(codes) - shape.length + 1, shape.sample
    prefix = Prefix(codes)
    pos = np.arange(m + w - 1)
    low = (prefix.of(pos, pos + shape.gram) & ~_POS) | pos.astype(np.uint64)
    reach = 1
    while reach * 2 <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < w:
        low = np.minimum(low[: m], low[w - reach : w - reach + m])
    owner = (low[:m] & _POS).astype(np.int64)
    turn = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    s, e = np.concatenate([[0], turn]), np.concatenate([turn - 1, [m - 1]])
    owner = owner[s]
    core = prefix.of(owner, owner + shape.length - w + 1)
    span, check = (mix(p.of(s, e + shape.length) + (owner - s).astype(np.uint64)) for p in (prefix, Prefix(codes, 1)))
    return s + at, e + at, owner + at, core, span, check


def cut(codes: np.ndarray, shape: Shape, s: np.ndarray, e: np.ndarray, owner: np.ndarray, size: int):
    """The tuples cut at distances from the owner that are multiples of `size`; index of the tuple each comes from."""
    pieces = [(k, d) for k in range(len(s)) for d in range((owner[k] - e[k]) // size, (owner[k] - s[k]) // size + 1)]
    k, d = np.array([p[0] for p in pieces], dtype=np.int64), np.array([p[1] for p in pieces], dtype=np.int64)
    far, near = owner[k] - d * size - size + 1, owner[k] - d * size  # earliest and latest start of the distance range
    lo, hi = np.maximum(far, s[k]), np.minimum(near, e[k])
    prefix = Prefix(codes)
    # the core is shared by all windows of the whole range, though a row may own a part of it only
    core = mix(prefix.of(near, far + shape.length) + d.astype(np.uint64)) if size > 1 else None
    span, check = (mix(p.of(lo, hi + shape.length) + (owner[k] - lo).astype(np.uint64)) for p in (prefix, Prefix(codes, 1)))
    return k, lo, hi, owner[k], span if core is None else core, span, check


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def first_round(docs: DataFrame, codes: Codes, shape: Shape) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                rows, out = [], []
                for i, row in enumerate(codes(b)):
                    found = sampled(row, shape)
                    rows.append(np.full(len(found[0]), b.lo + i))
                    out.append(found)
                at = pa.array(np.concatenate(rows).astype(np.int64))
                s, e, owner, core, span, check = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(owner.astype(np.int32)), *(pa.array(_signed(x)) for x in (core, span, check))],
                    NAMES,
                )

    return docs.mapInArrow(run, f"{id_column(docs)}, {TUPLE}").withColumn("n", F.lit(1))


def next_round(texts: DataFrame, codes: Codes, shape: Shape, size: int) -> DataFrame:
    """texts: rows with their branching tuples; they come out cut to `size` starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            for b in blocks(batch.column(2)):
                rows, out = [], []
                for i, row in enumerate(codes(b)):
                    t = lists[b.lo + i].values
                    s, e, owner, n = (t.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("s", "e", "owner", "n"))
                    k, *found = cut(row, shape, s, e, owner, size)
                    rows.append(np.full(len(k), b.lo + i))
                    out.append((*found, n[k]))
                at = pa.array(np.concatenate(rows).astype(np.int64))
                s, e, owner, core, span, check, n = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(owner.astype(np.int32)), *(pa.array(_signed(x)) for x in (core, span, check)), pa.array(n.astype(np.int32))],
                    [*NAMES, "n"],
                )

    return texts.mapInArrow(run, f"{id_column(texts)}, {TUPLE}, n int")


def id_column(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}"


def with_body(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash that tells apart rows which share a doc_id), text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("body"), text.alias("text"))


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["body"] == b["body"])


def repeated_starts(docs: DataFrame, codes: Codes, shape: Shape, ws: Workspace) -> DataFrame:
    """doc_id, body, s, e: ranges of window starts whose windows also start elsewhere; docs from with_body."""
    found = None
    tuples = first_round(docs, codes, shape)
    for level, size in enumerate((None, *shape.cuts)):
        if size is not None:
            lists = branching.groupBy("doc_id", "body").agg(F.collect_list(F.struct("s", "e", "owner", "n")).alias("tuples"))
            joined = docs.join(lists.hint("merge"), same_row(docs, lists)).select(docs["doc_id"], docs["body"], "text", "tuples")
            tuples = next_round(joined, codes, shape, size)
        tuples = ws.save(tuples, f"tuples{level}")
        same = (F.min("span") == F.max("span")) & (F.min("check") == F.max("check"))
        cores = tuples.groupBy("core").agg(F.sum("n").alias("total"), same.alias("single"))
        # a table of its own, so that both sides of the join are shuffled and a hot core's rows can be split
        cores = cores.filter("total > 1").select(F.col("core").alias("c"), "single")
        cores = ws.save(cores, f"cores{level}")
        repeats = ws.save(tuples.join(cores.hint("merge"), F.col("core") == F.col("c")).drop("c", "core"), f"repeats{level}")
        ws.drop(f"tuples{level}")
        place = F.struct("doc_id", "body", "s", "e", "owner")
        spans = ws.save(
            repeats.filter("not single").groupBy("span", "check").agg(F.sum("n").alias("m"), F.min(place).alias("one")), f"spans{level}"
        )
        whole = repeats.filter("single").select("doc_id", "body", "s", "e")
        twice = spans.filter("m > 1").select(F.col("span").alias("sp"), F.col("check").alias("ch"))
        more = repeats.filter("not single").join(twice.hint("merge"), (F.col("span") == F.col("sp")) & (F.col("check") == F.col("ch")), "left_semi").select("doc_id", "body", "s", "e")
        found = whole.unionByName(more) if found is None else found.unionByName(whole).unionByName(more)
        branching = spans.select("one.*", F.least("m", F.lit(2)).cast("int").alias("n"))
    return found


def spans_by_row(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text and the ranges found in it (null where none), for every row; rows that repeat share one set."""
    lists = found.groupBy("doc_id", "body").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))
    return docs.join(lists.hint("merge"), same_row(docs, lists), "left").select(docs["doc_id"], "text", "ranges")


def covered(n: int, ranges: pa.Scalar, length: int) -> np.ndarray:
    """Which of n symbols the windows that start in the ranges cover."""
    if not ranges.is_valid:
        return np.zeros(n, dtype=bool)
    t = ranges.values
    s, e = (t.field(f).to_numpy(zero_copy_only=False) for f in ("s", "e"))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, e + length, -1)
    return np.cumsum(edge[:-1]) > 0
