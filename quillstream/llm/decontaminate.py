"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their runs of white space become one blank.  An item of length n
may differ by e = floor(n * error_rate) edits.  Split into e + 1 pieces, at least one piece of it stands
unchanged in any text that holds it within e edits; an Aho-Corasick automaton finds all piece hits in one
pass, and Myers' bit-parallel distance verifies the text around each hit.

No match begins or ends inside a word: between two letters or digits, unless one is of a script that is written
without blanks.  So the text around a hit is read twice: forwards for where a match may end, and from each such place
backwards for where it begins.  Items of all lengths follow these rules; a short one has no edit to spare.

Defined results: null and empty texts match nothing; null and empty items are no test items; repeated rows each
get their matches; other columns are ignored by matches() and pass through decontaminate().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.05
#: Scripts without blanks between words: Thai to Tibetan, Burmese, Khmer, and Han with its neighbours.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
ITEM_BYTES = 16 << 20  #: test items that one pass over the documents holds in each worker


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 consecutive pieces with their places, as even as can be."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def in_word(ch: str) -> bool:
    return ch.isalnum() and not any(a <= ord(ch) <= b for a, b in UNSPACED)


def border(text: str, at: int) -> bool:
    """Whether a match may begin or end before the character at this place."""
    return not (0 < at < len(text) and in_word(text[at - 1]) and in_word(text[at]))


def myers(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character the fewest edits between the pattern and what ends there: any substring, or the whole text so far if anchored."""
    m = len(pattern)
    full, high, first = (1 << m) - 1, 1 << (m - 1), int(anchored)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    pv, mv, score = full, 0, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1 | first) & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        yield score


def best_match(item: str, text: str, lo: int, hi: int, errors: int) -> tuple[int, int, int] | None:
    """Fewest edits, start and end of a substring between borders that ends in text[lo:hi]."""
    ends = sorted((n, j) for j, n in enumerate(myers(item, text[lo:hi]), lo + 1) if n <= errors and border(text, j))
    best, back = None, item[::-1]
    for least, end in ends:
        if best and best[0] <= least:
            break
        reach = max(0, end - len(item) - errors)
        for i, n in enumerate(myers(back, text[reach:end][::-1], anchored=True), 1):
            if n <= errors and (best is None or n < best[0]) and border(text, end - i):
                best = (n, end - i, end)
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for at, piece in pieces(t, e):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def match(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """item id, edits, start and end in the normalised text of a best match of each item."""
        text = normal(text)
        if not text or not self.any:
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, tuple[int, int, int]] = {}
        for last, (n, uses) in self.automaton.iter(text):
            for k, at in uses:
                if k in found:
                    continue
                _, t, e = self.items[k]
                lo = last + 1 - n - at
                if not e:  # the hit is the whole item
                    if border(text, lo) and border(text, last + 1):
                        found[k] = (0, lo, last + 1)
                    continue
                span, old = (max(0, lo - e), min(len(text), lo + len(t) + e)), spans.setdefault(k, [])
                if old and span[0] <= old[-1][1]:  # neighbouring hits of an item are verified together
                    old[-1] = (min(old[-1][0], span[0]), max(old[-1][1], span[1]))
                else:
                    old.append(span)
        for k, places in spans.items():
            _, t, e = self.items[k]
            for lo, hi in places:
                got = best_match(t, text, lo, hi, e) if hi - lo >= len(t) - e else None
                if got and (k not in found or got[0] < found[k][0]):
                    found[k] = got
        return [(self.items[k][0], *x) for k, x in found.items()]


@lru_cache(2)
def matcher(items: tuple, error_rate: float) -> Matcher:
    return Matcher(list(items), error_rate)


def _blocks(docs: DataFrame, items: DataFrame) -> Iterator:
    """Broadcasts of the test items, ITEM_BYTES at most each: a larger benchmark takes more passes and no more memory."""
    items = items.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull() & F.col("text").rlike(r"\S"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total * 2 // ITEM_BYTES
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield docs.sparkSession.sparkContext.broadcast(tuple(sorted({(r.item_id, normal(r.text)) for r in rows})))


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, edits, start, end: every document and item that it holds.  Documents are never shuffled."""
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    out = None
    for shared in _blocks(docs, items):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            m = matcher(shared.value, error_rate)
            for pdf in batches:
                found = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for x in m.match(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "edits", "start", "end"])

        part = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no test item; each row is judged by its own text, where it stands."""
    at = docs.columns.index("text")
    for shared in _blocks(docs, items):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = matcher(shared.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not m.match(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
