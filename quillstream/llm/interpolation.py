"""A bigram model by deleted interpolation.

    p(w | v) = L2 * c(v, w) / c(v) + L1 * c(w) / N + L0 / (V + 1)

with the weights L taken by the frequency of the context v, in buckets of powers of two.  They are learned by
expectation-maximisation: counts of the training folds but one stand against the counts of that one.

Words and bigrams are 64-bit hashes.  All counts are Spark aggregates over rows that workers combine before they
leave (FLUSH codes at a time).  The counts of the HEAD most frequent words, and of as many bigrams, go to all
workers; those of others are joined to the places that hold them, in PASSES passes that bound the disk.  Outside
the head no key makes up more than one in HEAD of the training tokens, so none makes a large task; one that only
rows outside the training folds hold has no count, and a skew join may split it.

Defined results: a null or empty text is its end token alone; a null doc_id is in no fold, its row is scored
and not learned from; repeated rows are documents of their own in every count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix, words
from .frames import Workspace, partitions, small_maps

HEAD = 1 << 20
PASSES = 2
FLUSH = 1 << 21  #: tokens that a worker combines at once
ROUNDS = 12
TEST, DELETED = 0, 1  #: folds: never learned from; held out of the counts that weights are learned against
EVEN = np.uint64((1 << 64) - 2)
END, BEGIN = (mix(np.array([x], dtype=np.uint64))[0] & EVEN for x in (0xE0D, 0xBE6))
BUCKETS = 24


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(c))."""
    return np.minimum(np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows, an end after each, and their rows."""
    w = words(block, lower=True)
    n = w.counts + 1
    row = np.repeat(np.arange(len(n)), n)
    out = np.empty(int(n.sum()), dtype=np.uint64)
    ends = np.cumsum(n) - 1
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    out[inner], out[ends] = w.hash & EVEN, END
    return out, row


def before(code: np.ndarray, row: np.ndarray) -> np.ndarray:
    out = np.empty_like(code)
    out[1:] = code[:-1]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = row[1:] != row[:-1]
    out[fresh] = BEGIN
    return out


def pair(prev: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(prev * np.uint64(0x9E3779B97F4A7C15) + code) | np.uint64(1)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Head:
    """Hashes with their counts, found by their high bits: hashes spread evenly, so few share those."""

    def __init__(self, keys: np.ndarray, *counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], [c[order] for c in counts]
        self.bits = max(1, int(len(keys)).bit_length())
        self.start = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The counts at places that find() gave, 0 for none."""
        if not len(self.keys):
            return np.zeros((len(self.counts), len(at)), dtype=np.int64)
        return np.stack([np.where(at >= 0, c[at], 0) for c in self.counts])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, -1 for none."""
        out = np.full(len(keys), -1, dtype=np.int64)
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[slot], self.start[slot + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            here = at[left]
            hit = self.keys[here] == keys[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < stop[left]]
        return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = np.sort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys)))


def keyed(docs: DataFrame, fold: Column) -> DataFrame:
    """id and body (which rows with one doc_id and text share), fold (-1: none), text.

    A doc_id of integers is its own id, so body has only to tell apart the texts of one doc_id; others, and null
    ones, are hashed."""
    text = F.coalesce("text", F.lit(""))
    known = F.col("doc_id").cast("long") if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64("doc_id", F.lit(1))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(text, F.lit(1))).otherwise(known)
    return docs.select("doc_id", own.alias("id"), F.hash("doc_id", text, F.length(text)).alias("body"), F.coalesce(fold, F.lit(-1)).cast("int").alias("fold"), text.alias("text"))


def counted(rows: DataFrame, n_parts: int) -> DataFrame:
    """key, c (training count), d (count in the deleted fold) of the training words and bigrams; a bigram's key is odd.

    Workers combine FLUSH codes each; a second combination before the shuffle would find few equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[], []]  # codes of folds that are retained, deleted

        def flush():
            for kind, parts in enumerate(kept):
                if parts:
                    keys, n = distinct(np.concatenate(parts))
                    parts.clear()
                    yield pa.RecordBatch.from_arrays([signed(keys), pa.array(n), pa.array(n * kind)], ["key", "c", "d"])

        held = 0
        for batch in batches:
            fold = batch.column(0).to_numpy()
            for b in blocks(batch.column(1)):
                code, row = tokens(b)
                deleted = fold[b.lo + row] == DELETED
                for keys in (code, pair(before(code, row), code)):
                    kept[0].append(keys[~deleted])
                    kept[1].append(keys[deleted])
                held += 2 * len(code)
                if held >= FLUSH:
                    held = 0
                    yield from flush()
        yield from flush()

    out = rows.filter(F.col("fold") > TEST).select("fold", "text").mapInArrow(run, "key long, c long, d long")
    return out.repartition(n_parts, "key").groupBy("key").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def rare_words(rows: DataFrame, counts: DataFrame, head) -> DataFrame:
    """i, y, tails: of each distinct row (id, body) the counts of its words that are not in the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                w = words(b, lower=True)
                code = w.hash & EVEN
                rare = head.value.find(code) < 0
                at = pa.array(b.lo + w.row[rare])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), signed(code[rare])], ["id", "body", "w"])

    found = rows.select("id", "body", "text").mapInArrow(run, "id long, body int, w long").distinct()
    joined = found.join(counts.select(F.col("key").alias("w"), "c", "d").hint("merge"), "w")
    return joined.groupBy(F.col("id").alias("i"), F.col("body").alias("y")).agg(F.collect_list(F.struct("w", "c", "d")).alias("tails"))


def with_tails(rows: DataFrame, tails: DataFrame) -> DataFrame:
    near = (F.col("id") == F.col("i")) & (F.col("body") == F.col("y"))
    return rows.join(tails.hint("merge"), near, "left").select("id", "body", "fold", "text", "tails")


class Places:
    """The tokens of a block with the counts of each and of the one before it."""

    def __init__(self, b: Block, head: Head, tails: pa.Array | None, n_docs: tuple[int, int]):
        self.code, self.row = tokens(b)
        at = head.find(self.code)
        both = head.of(at)
        end = self.code == END
        both[:, end] = np.array(n_docs)[:, None]
        common = (at >= 0) | end
        rare = np.flatnonzero(~common)
        if tails is not None and len(rare):
            flat = tails.flatten()
            size = tails.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            if len(flat):
                # a row's own words only: word and row make one key
                w, c, d = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("w", "c", "d"))
                own = pair(np.repeat(np.arange(len(size), dtype=np.uint64), size), w.view(np.uint64))
                order = np.argsort(own)
                own = own[order]
                seek = pair(self.row[rare].astype(np.uint64), self.code[rare])
                j = np.minimum(np.searchsorted(own, seek), len(own) - 1)
                ok = own[j] == seek
                both[0, rare[ok]], both[1, rare[ok]] = c[order[j[ok]]], d[order[j[ok]]]
        prev = before(self.code, self.row)
        first = prev == BEGIN
        self.key = pair(prev, self.code)
        (self.cw, self.dw), (self.cv, self.dv) = both, np.roll(both, 1, axis=1)
        self.cv[first], self.dv[first] = n_docs
        self.common = common & (first | np.roll(common, 1))  # both counts come from the head

    def only(self, keep: np.ndarray) -> Places:
        out = copy(self)
        out.row, out.key, out.cw, out.cv = (x[keep] for x in (self.row, self.key, self.cw, self.cv))
        return out


def _pieces(batch: pa.RecordBatch, text: int) -> Iterator[tuple[Block, pa.Array]]:
    """Blocks of the text column, and their rows of the tails, the column after it."""
    for b in blocks(batch.column(text)):
        yield b, batch.column(text + 1).slice(b.lo, b.hi - b.lo)


def held_counts(both: DataFrame, table: DataFrame, head, n_docs: tuple[int, int]) -> DataFrame:
    """context, seen, word, n: how often a held-out bigram occurs whose retained counts are these.

    Where the bigram was not retained (seen = 0) only the context's bucket matters, whose least count stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, tails in _pieces(batch, 0):
                p = Places(b, head.value, tails, n_docs)
                yield pa.RecordBatch.from_arrays([signed(p.key), pa.array(p.cv - p.dv), pa.array(p.cw - p.dw)], ["key", "context", "word"])

    held = both.filter(F.col("fold") == DELETED).select("text", "tails").mapInArrow(run, "key long, context long, word long")
    seen = table.filter("d > 0").select(F.col("key").alias("k"), (F.col("c") - F.col("d")).alias("seen"))
    least = F.when(F.col("context") > 0, F.pow(F.lit(2.0), F.length(F.bin("context")) - 1).cast("long")).otherwise(0)
    joined = held.join(seen, F.col("key") == F.col("k"))
    return joined.groupBy(F.when(F.col("seen") > 0, F.col("context")).otherwise(least).alias("context"), "seen", "word").agg(F.count(F.lit(1)).alias("n"))


def learn_weights(held: DataFrame, n_kept: int, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """L2, L1, L0 by bucket: each round is one aggregation over the held-out counts."""
    lam = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    lam[0] = 0.0, 0.8, 0.2
    b = F.least(F.when(F.col("context") > 0, F.length(F.bin("context"))).otherwise(0), F.lit(BUCKETS - 1)).cast("int")
    p2 = F.when(F.col("seen") > 0, F.col("seen") / F.col("context")).otherwise(0.0)
    rows = held.select(b.alias("b"), p2.alias("p2"), (F.col("word") / float(max(n_kept, 1))).alias("p1"), "n")
    for _ in range(rounds):
        at = [F.element_at(F.array(*[F.lit(float(x)) for x in lam[:, j]]), F.col("b") + 1) for j in range(3)]
        terms = rows.select("b", "n", (at[0] * F.col("p2")).alias("t2"), (at[1] * F.col("p1")).alias("t1"), (at[2] / (vocabulary + 1)).alias("t0"))
        share = F.col("n") / (F.col("t2") + F.col("t1") + F.col("t0"))
        got = terms.groupBy("b").agg(*[F.sum(share * F.col(t)).alias(t) for t in ("t2", "t1", "t0")]).collect()
        old = lam.copy()
        for r in got:
            total = r.t2 + r.t1 + r.t0
            if total > 0:
                lam[r.b] = np.maximum(np.array([r.t2, r.t1, r.t0]) / total, [0, 1e-6, 1e-6])
                lam[r.b] /= lam[r.b].sum()
        if np.abs(lam - old).max() < 1e-4:
            break
    return lam


class Model:
    """What workers need: frequent words and bigrams, the weights and the totals."""

    def __init__(self, lam: np.ndarray, n: int, v: int, n_docs: tuple[int, int]):
        self.lam, self.n, self.v, self.n_docs = lam, n, v, n_docs

    def terms(self, p: Places) -> tuple[np.ndarray, np.ndarray]:
        """rest and q: a token's probability is rest * (1 + q * c(v, w))."""
        l2, l1, l0 = self.lam[bucket(p.cv)].T
        rest = l1 * p.cw / max(self.n, 1) + l0 / (self.v + 1)
        return rest, np.where((p.cv > 0) & (p.cw > 0), l2 / np.maximum(p.cv, 1) / rest, 0.0)


def own_scores(both: DataFrame, head, hot, model: Model) -> DataFrame:
    """Each row's n_tokens, n_known, base and what its score owes to words and frequent bigrams (key is null);
    and, with key and q, its bigrams outside the head that hold a word outside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, tails in _pieces(batch, 2):
                p = Places(b, head.value, tails, model.n_docs)
                k = b.hi - b.lo
                rest, q = model.terms(p)
                at = hot.value.find(p.key)
                score = np.log10(rest) + np.log1p(q * hot.value.of(at)[0]) / np.log(10)
                base = np.log10((p.cw + 0.1) / (model.n + 0.1 * (model.v + 1)))
                sums = [np.bincount(p.row, weights=x, minlength=k) for x in (p.cw > 0, base, score)]
                cold = np.flatnonzero((at < 0) & (q > 0) & ~p.common)
                row = pa.array(np.concatenate([np.arange(k), p.row[cold]]) + b.lo)
                pad = pa.nulls(len(cold), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row), batch.column(1).take(row),
                        pa.concat_arrays([pa.nulls(k, pa.int64()), signed(p.key[cold])]), pa.concat_arrays([pa.nulls(k, pa.float32()), pa.array(q[cold].astype(np.float32))]),
                        pa.concat_arrays([pa.array(np.bincount(p.row, minlength=k)), pad]), pa.concat_arrays([pa.array(sums[0].astype(np.int64)), pad]),
                        pa.concat_arrays([pa.array(sums[1]), pad.cast(pa.float64())]), pa.concat_arrays([pa.array(sums[2]), pad.cast(pa.float64())]),
                    ],
                    ["id", "body", "key", "q", "n_tokens", "n_known", "base", "part"],
                )

    return both.select("id", "body", "text", "tails").mapInArrow(run, "id long, body int, key long, q float, n_tokens long, n_known long, base double, part double")


def cold_places(rows: DataFrame, head, hot, model: Model, step: int, passes: int) -> DataFrame:
    """id, body, key, q: this pass's bigrams outside the head whose words are both in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(2)):
                p = Places(b, head.value, None, model.n_docs)
                p = p.only(np.flatnonzero(p.common & ((p.key >> np.uint64(33)) % np.uint64(passes) == step)))
                p = p.only(np.flatnonzero(hot.value.find(p.key) < 0))
                _, q = model.terms(p)
                keep = np.flatnonzero(q > 0)
                row = pa.array(b.lo + p.row[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), signed(p.key[keep]), pa.array(q[keep].astype(np.float32))], ["id", "body", "key", "q"])

    return rows.select("id", "body", "text").mapInArrow(run, "id long, body int, key long, q float")


def frequent(counts: DataFrame, most: int, *columns: str) -> Head:
    """The keys of the highest whole levels of frequency that hold at most so many keys."""
    level = F.floor(F.log2("c") * 16)
    cut, held = 1 << 20, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        held += r["count"]
        if held > most:
            break
        cut = r.level
    top = counts.filter(level >= cut).select("key", *columns).toArrow()
    return Head(top["key"].to_numpy().view(np.uint64), *[top[x].to_numpy() for x in columns])


def interpolated_scores(docs: DataFrame, ws: Workspace, fold: Callable[[], Column], head: int = HEAD, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    fold: doc_id's fold, 0 never learned from, 1 held out while weights are learned."""
    context = docs.sparkSession.sparkContext
    rows = keyed(docs, fold())
    counts = ws.save(counted(rows, partitions(docs.sparkSession)), "counts")
    of_pass = lambda step: F.shiftrightunsigned("key", 33) % passes == step
    words_ = ws.save(counts.filter(F.col("key") % 2 == 0), "words")
    bigrams = counts.filter(F.col("key") % 2 != 0)
    total = words_.agg(F.sum("c").alias("n"), F.sum("d").alias("d"), F.count(F.lit(1)).alias("v")).first()
    n, kept, v = total.n or 0, (total.n or 0) - (total.d or 0), total.v
    common, hot = context.broadcast(frequent(words_, head, "c", "d")), context.broadcast(frequent(bigrams, head, "c"))
    end = words_.filter(F.col("key") == int(END.view(np.int64))).first()
    n_docs = (int(end.c), int(end.d)) if end else (0, 0)
    both = with_tails(rows, ws.save(rare_words(rows, words_, common), "tails"))
    with small_maps(docs.sparkSession):
        held = ws.save(held_counts(both, bigrams, common, n_docs), "held")
    model = Model(learn_weights(held, kept, v), n, v, n_docs)
    ws.drop("held"), ws.drop("words")
    own = ws.save(own_scores(both, common, hot, model), "own")
    ws.drop("tails")
    parts = own.filter("key is null").select("id", "body", F.lit(1).cast("long").alias("copies"), *RESULT[1:])
    for step in range(passes):
        places = cold_places(rows, common, hot, model, step, passes).unionByName(own.filter(of_pass(step)).select("id", "body", "key", "q"))
        c = bigrams.filter(of_pass(step)).select(F.col("key").alias("k"), "c")
        met = places.join(c, F.col("key") == F.col("k")).groupBy("id", "body").agg(F.sum(F.log10(1 + F.col("q").cast("double") * F.col("c"))).alias("part"))
        with small_maps(docs.sparkSession):
            met = ws.save(met, f"scores{step}")
        parts = parts.unionByName(met.select("id", "body", *[F.lit(0).cast("long").alias(x) for x in RESULT[:3]], F.lit(0.0).alias("base"), "part"))
    sums = parts.groupBy(F.col("id").alias("i"), F.col("body").alias("y")).agg(*[F.sum(x).alias(x) for x in RESULT])
    each = lambda x: F.col(x) / F.col("copies")
    return rows.drop("text").join(sums.hint("merge"), (F.col("id") == F.col("i")) & (F.col("body") == F.col("y"))).select(
        "doc_id", (F.col("fold") == TEST).alias("held_out"), each("n_tokens").cast("long").alias("n_tokens"), each("n_known").cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("part").alias("score"),
    )


RESULT = ["copies", "n_tokens", "n_known", "base", "part"]
