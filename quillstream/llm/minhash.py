"""MinHash near-dedup with b-bit signatures.

Each text becomes the set of hashes of its distinct shingles (n words, A-Z lower-cased; a shorter text is
one shingle).  Texts with the same set form a class and one row stands for it.  Of PERMUTATIONS minima, bands
of ROWS full minima bring candidates together, and the low BITS bits of all minima, packed into longs, give
by bit counts the share m of equal ones and the collision-corrected estimate (m - 2**-b) / (1 - 2**-b).
Pairs estimated well under the threshold are dropped.  So are those whose odd sketches (the parity of the number
of a set's hashes in each of ODD cells) differ in more cells than sets of that similarity can differ in members:
that bound is exact, and sharp for sets of up to about 1.7 * ODD shingles.  All others are confirmed on their full sets.

Candidates come in two rounds, so that a bucket of n alike texts costs 2n pairs and no link is lost: first
each member against the bucket's smallest id and its most central member; then, between the components found so far, all pairs that
still share a bucket.  A pair inside one component needs no test, as it can't change the components.

At 32 bands of 4, a pair of similarity 0.75 escapes every band with probability 5e-6; at 0.8, 5e-8.

Defined results: null or empty texts, and texts without words, have the empty set, are linked with nothing
and kept; a null doc_id is linked with nothing and its row kept, component null; rows are judged by their own
texts, also where they share a doc_id, and only equal ones get the same result; ids are of any type that sorts; a
row that repeats a kept one is kept as well; other columns pass through keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, grams, mix, stream, words
from .frames import Workspace, partitions, unused
from .repeats import id_column, with_body

PERMUTATIONS, ROWS, BITS = 128, 4, 4
ODD = 1024  #: cells of the odd sketch
MARGIN = 0.2  #: five standard errors of the estimate
SALT = 256  #: pairs of one text that a task verifies, about
_MUL = stream(11, PERMUTATIONS) | np.uint64(1)
_ADD = stream(12, PERMUTATIONS)


def shingle_sets(block: Block, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = words(block, lower=True)
    at, codes = grams(w, n)
    bound = np.searchsorted(at, w.first)
    out = []
    for i, count in enumerate(w.counts.tolist()):
        if count >= n:
            out.append(np.unique(codes[bound[i] : bound[i + 1]]))
        elif count:
            short = w.hash[w.first[i] : w.first[i + 1]]
            out.append(mix(np.array([int(np.sum(short * stream(13, count), dtype=np.uint64)) ^ count], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(codes: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(codes), 2048):
        part = codes[a : a + 2048, None] * _MUL + _ADD
        np.minimum(low, part.min(axis=0), out=low)
    return low


def signature(codes: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Two check sums of the set, the band keys and the packed low bits."""
    mixed = mix(codes)
    low = minima(codes)
    # full minima are ordered by their high bits, so the low ones are taken after a mix
    fine = mix(low)
    bands = mix(mix(fine.reshape(-1, ROWS) * stream(14, ROWS)).sum(axis=1, dtype=np.uint64))
    per = 64 // BITS
    nibbles = (fine & np.uint64((1 << BITS) - 1)).reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return int(codes.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed)), bands, nibbles.sum(axis=1, dtype=np.uint64)


def odd_sketch(codes: np.ndarray) -> np.ndarray:
    odd = np.bincount((mix(codes) % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """What each row's set has instead of its members; docs from with_body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                size, c1, c2, bands, sketch, odd = [], [], [], [], [], []
                for codes in shingle_sets(b, n):
                    size.append(len(codes))
                    x = signature(codes) if len(codes) else (0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                    c1.append(x[0]), c2.append(x[1]), bands.append(x[2].view(np.int64)), sketch.append(x[3].view(np.int64))
                    odd.append(odd_sketch(codes))
                signed = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(b.lo, b.hi - b.lo) for i in (0, 1)), pa.array(size, pa.int64()), signed(c1), signed(c2), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    ["doc_id", "body", "n_shingles", "c1", "c2", "bands", "sketch", "odd"],
                )

    return docs.mapInArrow(run, f"{id_column(docs)}, body long, n_shingles long, c1 long, c2 long, bands array<long>, sketch array<long>, odd array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity from packed low bits."""
    equal = F.lit(0)
    fold = sum(1 << (BITS * i) for i in range(64 // BITS))
    low = F.lit(fold if fold < 1 << 63 else fold - (1 << 64)).cast("long")
    for i in range(PERMUTATIONS * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        some = x
        for s in range(1, BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(x, s))
        equal = equal + F.lit(64 // BITS) - F.bit_count(some.bitwiseAND(low))
    chance = 2.0**-BITS
    return (equal / F.lit(float(PERMUTATIONS)) - chance) / (1 - chance)


def differing(a: Column, b: Column) -> Column:
    """Cells in which two odd sketches differ: at most as many as members that one set has and the other lacks."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(ODD // 64)), F.lit(0))


def confirm(pairs: DataFrame, docs: DataFrame, where: DataFrame, ws: Workspace, name: str, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union; where: id, rep, body of a row with that set.

    Pairs of one text are dealt out in salted groups, each with its own copy of that text."""
    load = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("load"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    spots = where.select("id", "rep", F.col("body").alias("of")).join(wanted.hint("merge"), "id", "left_semi")
    texts = docs.join(spots.hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("body") == F.col("of"))).select("id", "text").dropDuplicates(["id"])
    texts = ws.save(texts, f"texts{name}")
    salts = F.explode(F.sequence(F.lit(0), F.floor(F.col("load") / SALT).cast("int")))
    left = texts.join(load.hint("merge"), texts["id"] == load["a"]).select("a", "load", F.col("text").alias("ta"), salts.alias("salt"))
    right = (
        pairs.join(load.hint("merge"), "a")
        .withColumn("salt", F.pmod(F.xxhash64("b"), F.floor(F.col("load") / SALT) + 1).cast("int"))
        .join(texts.hint("merge"), F.col("b") == F.col("id"))
        .select("a", "salt", "b", F.col("text").alias("tb"))
    )
    k = partitions(ws.spark)
    both = left.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("ta").alias("t")).unionByName(right.select("a", "salt", "b", F.col("tb").alias("t")))
    both = both.repartition(k, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            others = batch.column(2).to_pylist()
            for blk in blocks(batch.column(3)):
                keep_a, keep_b = [], []
                for i, codes in enumerate(shingle_sets(blk, n), blk.lo):
                    if others[i] is None:
                        hub, own = ids[i], codes
                        continue
                    assert hub == ids[i]
                    inner = len(np.intersect1d(own, codes, assume_unique=True))
                    if inner and 100 * inner >= percent * (len(own) + len(codes) - inner):
                        keep_a.append(hub), keep_b.append(others[i])
                yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    return ws.save(both.mapInArrow(run, "a long, b long"), f"links{name}")


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """id, root (the smallest id reachable) of every id in links(a, b).

    Each root points to the smallest root next to it, pointers are followed to their ends by doubling, and
    links shrink to those between different roots: the number of open roots halves at least each round."""
    edges, labels, step = links.select("a", "b"), None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        point = ws.save(point, f"point{name}_{step}_0")
        for jump in range(1, 64):
            ends = point.select(F.col("id").alias("x"), F.col("to").alias("end"))
            moved = ws.save(point.join(ends, F.col("to") == F.col("x")).select("id", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("far")), f"point{name}_{step}_{jump}")
            done = moved.filter("far").isEmpty()
            point = moved.select("id", "to")
            if done:
                break
        if labels is None:
            labels = point.select("id", F.col("to").alias("root"))
        else:
            labels = ws.save(
                labels.join(point.withColumnRenamed("id", "p"), F.col("root") == F.col("p"), "left").select("id", F.coalesce("to", "root").alias("root")), f"labels{name}_{step}"
            )
        p, q = point.select(F.col("id").alias("a"), F.col("to").alias("ra")), point.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        edges = ws.save(edges.join(p, "a").join(q, "b").filter("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"edges{name}_{step}")
        step += 1
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, ws: Workspace, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text)."""
    return _judged(docs, ws, n, percent).drop("body")


def _judged(docs: DataFrame, ws: Workspace, n: int, percent: int) -> DataFrame:
    """near_duplicates with body, which tells apart the texts of one doc_id."""
    docs = with_body(docs)
    sig = ws.save(signatures(docs, n), "signatures")
    whole = sig.filter("n_shingles > 0 and doc_id is not null")
    # a set's number is fixed once the table is written
    classes = whole.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min_by("body", "doc_id").alias("body")).withColumn("id", F.monotonically_increasing_id())
    classes = ws.save(classes, "classes")
    one = classes.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "rep", F.col("body").alias("of"), "id")
    reps = ws.save(
        whole.join(one.hint("merge"), (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("doc_id") == F.col("rep")) & (F.col("body") == F.col("of")))
        .select("id", F.col("n_shingles").alias("n"), "sketch", "odd", "bands").dropDuplicates(["id"]),
        "reps",
    )
    members = reps.select("id", F.posexplode("bands").alias("band", "key")).withColumn("key", F.xxhash64("band", "key")).select("id", "band", "key")
    buckets = members.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = ws.save(members.join(buckets.hint("merge"), "key").select("key", "band", "id", "hub", "size"), "members")
    # the member that meets most others over all its buckets is nearest to the source of a group of copies
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    centers = members.join(weight.hint("merge"), "id").groupBy(F.col("key").alias("ck")).agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("center"))
    slim = reps.select("id", "n", "sketch", "odd")
    floor = percent / 100 - MARGIN

    def plausible() -> Column:
        sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        odd = (100 + percent) * differing(F.col("oa"), F.col("ob")) <= (100 - percent) * (F.col("na") + F.col("nb"))
        return sizes & odd & (estimate(F.col("sa"), F.col("sb")) >= floor)

    def described(pairs: DataFrame) -> DataFrame:
        a = slim.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("odd").alias("oa"))
        b = slim.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("odd").alias("ob"))
        out = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
        return out.filter(plausible()).select("a", "b")

    stars = members.select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(
        members.join(centers.hint("merge"), F.col("key") == F.col("ck")).select(F.col("center").alias("a"), F.col("id").alias("b"))
    )
    stars = ws.save(stars.filter("a != b").distinct(), "stars")
    links = confirm(ws.save(described(stars), "pairs1"), docs, classes, ws, "1", n, percent)
    empty = links.isEmpty()
    found = None if empty else components(links, ws, "1")
    # second round: buckets that hold several components
    placed = members if found is None else members.join(found.hint("merge"), "id", "left")
    placed = placed.select("key", "band", "id", (F.col("id") if found is None else F.coalesce("root", "id")).alias("comp"))
    placed = ws.save(placed, "placed")
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select(F.col("key").alias("k"))
    still = placed.join(split.hint("merge"), F.col("key") == F.col("k"), "left_semi")
    still = ws.save(still.join(reps.hint("merge"), "id"), "still")
    x = still.select(F.col("key").alias("kx"), F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("sketch").alias("sa"), F.col("odd").alias("oa"), F.col("bands").alias("ba"), "band")
    y = still.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("sketch").alias("sb"), F.col("odd").alias("ob"), F.col("bands").alias("bb"))
    # a pair comes out of the first band that it shares only, not of each
    first = F.array_position(F.zip_with("ba", "bb", lambda p, q: p == q), True) == F.col("band") + 1
    cross = x.join(
        y.hint("merge"),
        (F.col("kx") == F.col("key")) & (F.col("ca") < F.col("cb")) & plausible() & first,
    ).select("a", "b").distinct()
    tested = stars.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    cross = cross.join(tested.hint("merge"), (F.least("a", "b") == F.col("u")) & (F.greatest("a", "b") == F.col("v")), "left_anti")
    cross = ws.save(cross, "pairs2")
    if not cross.isEmpty():
        links = links.unionByName(confirm(cross, docs, classes, ws, "2", n, percent))
        if not links.isEmpty():
            found = components(links, ws, "2")
    merged = classes.select("c1", "c2", "rep", F.col("id").alias("root"))
    if found is not None:
        merged = classes.join(found.hint("merge"), "id", "left").select("c1", "c2", "rep", F.coalesce("root", "id").alias("root"))
        lowest = merged.groupBy(F.col("root").alias("r")).agg(F.min("rep").alias("least"))
        merged = merged.join(lowest.hint("merge"), F.col("root") == F.col("r")).select("c1", "c2", F.col("least").alias("rep"))
    merged = merged.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("rep").alias("component"))
    own = F.col("n_shingles") > 0
    out = sig.select("doc_id", "body", "n_shingles", "c1", "c2").join(merged.hint("merge"), own & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "body", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, ws: Workspace, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows that hold the smallest document of their group; other texts under the same doc_id are judged by themselves."""
    id_, body, key = unused(docs, "gone", "body", "key")
    gone = _judged(docs, ws, n, percent).filter("not kept").select(F.col("doc_id").alias(id_), F.col("body").alias(body)).distinct()
    gone = ws.save(gone, "gone")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(text, F.length(text)))
    return keyed.join(gone.hint("merge"), (F.col("doc_id") == F.col(id_)) & (F.col(key) == F.col(body)), "left_anti").select(*docs.columns)
