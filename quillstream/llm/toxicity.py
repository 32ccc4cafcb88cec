"""Toxicity by class-conditional Kneser-Ney models.

Each class has a model of words as sequences of UTF-8 bytes (A-Z lower-cased) between word borders: n-gram
counts of the class, discounted, over lower orders that both classes share as Kneser-Ney continuation counts
(distinct left neighbours), so that a rare expression, or a new form of a known stem, borrows from either
class alike and tells them apart only where class counts do.  A word counts once a document, which keeps a
word that one document repeats from passing for a trait of its class.

A document is described by its length-normalised log-likelihood ratio (mean over its words) and by the same
ratio over its most toxic few words; a logistic curve over both, fitted on labelled documents that the
counts leave out, gives the score.

The fit reads a bounded sample: at most `sample` labelled documents, in hash order of doc_id, and all n-grams of
their words.  The mean of the worst words is an addition to the method, for long texts with few toxic words.  Scoring is one narrow pass over all whole texts.

Defined results: null and empty texts score as texts without evidence; without any label, or with one class
only, every score is the training share of toxic labels; a doc_id with several labels is toxic if one of
them says so; null labels are none; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, words
from .frames import Workspace

N = 5
DISCOUNT = 0.75
WORST = 3  #: the most toxic words that the second ratio is taken over
BITS, BORDER = np.uint64(9), 256  #: a symbol is a byte or the border
SAMPLE = 16_000
THRESHOLD = 0.3


def word_grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that predict each byte of each word and its end, as packed codes, and where each word's begin."""
    size = end - start + 1
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - start, size)
    symbols = np.append(data, 0)[at].astype(np.uint64)
    symbols[first[1:] - 1] = BORDER
    out, stop = symbols.copy(), np.zeros(len(symbols), dtype=bool)
    for j in range(1, N):
        before = np.full(len(symbols), BORDER, dtype=np.uint64)
        before[j:] = symbols[:-j]
        stop |= before == BORDER
        before[stop] = BORDER
        out |= before << (BITS * np.uint64(j))
    return out, first[:-1]


@dataclass
class Model:
    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    weights: np.ndarray  # of the two ratios, and the constant
    scale: np.ndarray

    def ratios(self, codes: np.ndarray) -> np.ndarray:
        """log p(toxic class) - log p(ordinary class) of each n-gram; a shared lower order cancels where both lack it."""
        out = np.zeros(len(codes))
        for table, values, key in ((self.contexts, self.context_ratio, codes >> BITS), (self.grams, self.gram_ratio, codes)):
            if len(table):
                i = np.minimum(np.searchsorted(table, key), len(table) - 1)
                out = np.where(table[i] == key, values[i], out)
        return out

    def features(self, block: Block) -> np.ndarray:
        """Mean ratio of each row's words, and that of the highest few."""
        w = words(block, lower=True)
        out = np.zeros((len(w.first) - 1, 2))
        if not len(w.hash):
            return out
        _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        low = np.where((block.data >= 0x41) & (block.data <= 0x5A), block.data + 0x20, block.data)
        codes, first = word_grams(low, w.start[at], w.end[at])
        value = np.add.reduceat(self.ratios(codes), first)[back]
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b > a:
                v = value[a:b]
                top = np.partition(v, len(v) - WORST)[-WORST:] if len(v) > WORST else v
                out[i] = v.mean(), top.sum() / WORST
        return out

    def scores(self, block: Block) -> np.ndarray:
        x = self.features(block) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30)))


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log ratio tables of n-grams and of contexts from distinct codes and their counts by class (two columns)."""
    grams = np.unique(codes)
    order = np.searchsorted(grams, codes)
    by_class = np.zeros((len(grams), 2))
    np.add.at(by_class, order, counts)
    # shared lower orders, the lowest first: distinct left neighbours, interpolated
    levels, cur = [], grams
    for o in range(N - 1, 0, -1):
        cur, left = np.unique(cur & np.uint64((1 << (9 * o)) - 1), return_counts=True)
        levels.append((cur, left))
    p_keys, p = np.zeros(1, dtype=np.uint64), np.array([1.0 / 257])
    for o, (keys, left) in zip(range(1, N), reversed(levels), strict=True):
        ctx, where, kinds = np.unique(keys >> BITS, return_inverse=True, return_counts=True)
        total = np.bincount(where, weights=left)
        lower = p[np.searchsorted(p_keys, keys & np.uint64((1 << (9 * (o - 1))) - 1))]
        p = (np.maximum(left - DISCOUNT, 0) + DISCOUNT * kinds[where] * lower) / total[where]
        p_keys = keys
    shared = p[np.searchsorted(p_keys, grams & np.uint64((1 << (9 * (N - 1))) - 1))]
    ctx, where = np.unique(grams >> BITS, return_inverse=True)
    log_p, log_back = [], []
    for k in (0, 1):
        total = np.bincount(where, weights=by_class[:, k])
        kinds = np.bincount(where, weights=by_class[:, k] > 0)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        log_back.append(np.log(back))
        log_p.append(np.log(np.where(total[where] > 0, np.maximum(by_class[:, k] - DISCOUNT, 0) / np.maximum(total[where], 1), 0) + back[where] * shared))
    return grams, log_p[1] - log_p[0], ctx, log_back[1] - log_back[0]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.array([1.0] * (x.shape[1] - 1) + [1e-6])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, train, sample: int = SAMPLE) -> Model:
    """train: a predicate over doc_id; other rows' labels are never read."""
    chosen = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(ws.save(chosen, "chosen")), F.col("doc_id") == F.col("_id"))
    # equal texts count once, as toxic if one of them is
    rows = rows.filter(F.col("text").isNotNull()).groupBy("text").agg(F.max("label").alias("label")).select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("curve"))
    rows = ws.save(rows, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for b in blocks(batch.column(0)):
                w = words(b, lower=True)
                if not len(w.hash):
                    continue
                row = w.row
                order = np.lexsort((w.hash, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
                one = order[new]  # a word once a document
                low = np.where((b.data >= 0x41) & (b.data <= 0x5A), b.data + 0x20, b.data)
                codes, first = word_grams(low, w.start[one], w.end[one])
                toxic = np.repeat(label[b.lo + row[one]] == 1, np.diff(np.append(first, len(codes))))
                keys, back = np.unique(codes, return_inverse=True)
                ones = np.bincount(back, weights=toxic).astype(np.int64)
                every = np.bincount(back).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(every - ones), pa.array(ones)], ["gram", "n0", "n1"])

    grams = rows.filter("not curve").select("text", "label").mapInArrow(count, "gram long, n0 long, n1 long")
    grams = grams.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    if len(grams):
        tables = kneser_ney(grams["gram"].to_numpy().astype(np.uint64), grams[["n0", "n1"]].to_numpy(dtype=float))
    else:
        tables = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))
    model = Model(*tables, np.zeros(3), np.ones(2))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                x = shared.value.features(b)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1).slice(b.lo, b.hi - b.lo)], ["a", "b", "label"])

    curve = rows.filter("curve").select("text", "label").mapInArrow(describe, "a double, b double, label int").toPandas()
    x, y = curve[["a", "b"]].to_numpy(), curve["label"].to_numpy(dtype=float)
    if 0 < y.sum() < len(y):
        scale = np.maximum(x.std(axis=0), 1e-9)
        return Model(*tables, logistic(x / scale, y), scale)
    share = (y.sum() + 1e-3) / (len(y) + 1) if len(y) else 1e-3
    return Model(*tables, np.array([0.0, 0.0, np.log(share / (1 - share))]), np.ones(2))


def score(docs: DataFrame, model: Model, held_out, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                s = shared.value.scores(b)
                k = b.hi - b.lo
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, k), batch.column(2).slice(b.lo, k), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
