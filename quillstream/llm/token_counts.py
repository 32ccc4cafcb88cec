"""Token counts by prefix dynamic programming over a public byte-level BPE vocabulary.

For byte-pair encodings the encoding of every prefix of a piece ends in exactly one token t that stands
alone under the merges and is compatible with the last token of the prefix it extends: encoding the two
together gives the same two.  So tokens[j] = tokens[j - len(t)] + 1 fills in the exact count of *every*
prefix from left to right, and truncation or budget questions are look-ups.

Defined results: a null or empty text has 0 tokens; the literal special string inside a text is one
token, as the library's default has it; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, blocks

MEMO = 1_000_000  #: distinct pieces and token pairs that a worker keeps; beyond it starts afresh
SPECIAL = "<|endoftext|>"
LETTER, NUMBER, SPACE, OTHER = range(4)
# The suffixes that the vocabulary's splitting pattern cuts off after an apostrophe.
SHORT = "stmd"
LONG = ("re", "ve", "ll")
# The code points with the White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_class() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[WHITE] = SPACE
    return table


def piece_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; doc_starts are the positions where texts begin."""
    n = len(cp)
    kind = char_class()[cp]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[doc_starts] = True
    start = fresh[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before other text joins it if it is a blank, else stands alone
    b = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fresh[1:n]) + 1
    start[b - 1] = True
    start[b[cp[b - 1] == 32]] = False
    at = np.flatnonzero((cp == 39) & start)
    pad = np.concatenate([cp, np.zeros(3, dtype=cp.dtype)])
    edge = np.concatenate([fresh, np.ones(3, dtype=bool)])
    for suffix in (*SHORT, *LONG):
        k = len(suffix)
        hit = at
        for j, ch in enumerate(suffix, 1):
            hit = hit[(pad[hit + j] == ord(ch)) & ~edge[hit + j]]
        start[hit + 1] = False
        if k == 2:
            start[hit + 2] = fresh[hit + 2]
        after = hit + k + 1
        start[after[after < n]] = True
    return start


class PrefixTokens:
    """Exact token counts of all prefixes of a text."""

    def __init__(self, tokenizer_json: str):
        import tiktoken

        with open(tokenizer_json, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = self._byte_of_char()
        ranks = {bytes(back[c] for c in k): v for k, v in vocab.items()}
        self._bpe = tiktoken.Encoding("prefix", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        # only tokens that the merges leave whole can end a prefix
        self.rank = {k: v for k, v in ranks.items() if len(self._bpe.encode_single_piece(k)) == 1}
        self.longest = max(map(len, self.rank))
        self._joins: dict[int, bool] = {}
        self._count: dict[bytes, int] = {}

    @staticmethod
    def _byte_of_char() -> dict[str, int]:
        """The vocabulary file writes bytes that are not printable as characters from U+0100 on, in order."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def _compatible(self, left: bytes, right: bytes) -> bool:
        pair = [self.rank[left], self.rank[right]]
        if len(self._joins) >= MEMO:
            self._joins.clear()
        found = self._joins[pair[0] << 20 | pair[1]] = self._bpe.encode_single_piece(left + right) == pair
        return found

    def piece(self, data: bytes) -> list[int]:
        """tokens[j] of the first j bytes of one pre-token, for every j."""
        n, longest, rank, joins = len(data), self.longest, self.rank.get, self._joins.get
        tokens, last, ids = [0] * (n + 1), [b""] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j - longest if j > longest else 0, j):
                t = data[i:j]
                r = rank(t)
                if r is None:
                    continue
                if i:
                    ok = joins(ids[i] << 20 | r)
                    if ok is None:
                        ok = self._compatible(last[i], t)
                    if not ok:
                        continue
                tokens[j], last[j], ids[j] = tokens[i] + 1, t, r
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return tokens

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Token counts of text[:k] for k = 0..len(text), each as if the prefix were the whole text."""
        text = text or ""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        base = pos = 0
        for i, part in enumerate(text.split(SPECIAL)):
            if i:
                # a special string that is cut off is ordinary text after what stands before it
                for k in range(1, len(SPECIAL)):
                    out[pos + k] = base + self._plain(prev + SPECIAL[:k])[-1]
                base += self._plain(prev)[-1] + 1
                pos += len(SPECIAL)
            counts = self._plain(part)
            out[pos : pos + len(part) + 1] = base + counts
            pos, prev = pos + len(part), part
        return out

    def _plain(self, text: str) -> np.ndarray:
        out = np.zeros(len(text) + 1, dtype=np.int64)
        if not text:
            return out
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.flatnonzero(piece_starts(cp, np.array([0])))
        ends = np.append(starts[1:], len(text))
        kind = char_class()[cp]
        total, run = 0, (0, 0)  # run: where the last run of white space began, and the count before it
        for s, e in zip(starts, ends, strict=True):
            part = text[s:e]
            inner = np.array(self.piece(part.encode("utf-8", "surrogatepass")))
            at = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part])
            out[s + 1 : e + 1] = total + inner[at]
            if part[0] == "'" and len(part) == 3 and part[1:] in LONG:  # cut off in the middle, it is two pieces
                out[s + 2] = total + self.piece(b"'")[-1] + self.piece(part[1].encode())[-1]
            if kind[s] == SPACE and (s == 0 or kind[s - 1] != SPACE):
                run = (s, total)
            if kind[s] == SPACE and run[0] < s:  # a prefix that ends in white space keeps the run together
                out[s + 1] = run[1] + self.piece(text[run[0] : s + 1].encode())[-1]
            total += int(inner[-1])
        return out

    def cut(self, text: str | None, budget: int) -> int:
        """Characters in the longest prefix of at most `budget` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])

    def block(self, block: Block) -> np.ndarray:
        """Token counts of a block's texts: the last entries of their prefix tables."""
        out = np.zeros(block.hi - block.lo, dtype=np.int64)
        if not len(block.data):
            return out
        whole = block.data.tobytes()
        text = whole.decode("utf-8", "surrogatepass")
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
        first = lead[block.offsets]
        starts = np.flatnonzero(piece_starts(cp, first[first < len(cp)]))
        at = np.append(np.flatnonzero((block.data & 0xC0) != 0x80), len(block.data))
        lo, hi = at[starts], at[np.append(starts[1:], len(cp))]
        if len(self._count) > MEMO:
            self._count.clear()
        known = self._count
        pieces = [whole[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        sizes = list(map(known.get, pieces))
        if None in sizes:
            for piece in {p for p, n in zip(pieces, sizes) if n is None}:
                known[piece] = self.piece(piece)[-1]
            sizes = [known[p] for p in pieces]
        cum = np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])
        bounds = np.searchsorted(lo, block.offsets)
        out += cum[bounds[1:]] - cum[bounds[:-1]]
        if SPECIAL.encode() in whole:
            for i in range(len(out)):
                if SPECIAL.encode() in (t := block.text(i)):
                    parts = t.decode("utf-8", "surrogatepass").split(SPECIAL)
                    out[i] = len(parts) - 1 + sum(int(self._plain(p)[-1]) for p in parts)
        return out


@lru_cache(2)
def encoder(path: str) -> PrefixTokens:
    return PrefixTokens(path)


def token_counts(docs: DataFrame, tokenizer_json: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text); one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_json)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for b in blocks(column):
                n = enc.block(b)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(b.lo, b.hi - b.lo), pa.array(np.diff(b.offsets)), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
