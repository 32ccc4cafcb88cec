"""Vectorised text access for Arrow batches: words, their 64-bit hashes and n-gram hashes.

Texts stay UTF-8 bytes.  A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; those six
bytes never occur inside a multi-byte character, so byte runs and code-point runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64
#: 1 for a byte of a word, 0 for the six that part words
_INSIDE = bytes(0 if x in b"\x20\x09\x0A\x0B\x0C\x0D" else 1 for x in range(256))
LOWER = bytes(x + 0x20 if 0x41 <= x <= 0x5A else x for x in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiply-xorshift hash."""
    x = np.asarray(x, dtype=_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random words (a counter through the finaliser)."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15))


BYTE_CODE = stream(1, 256)
_LOWER_CODE = BYTE_CODE[np.frombuffer(LOWER, dtype=np.uint8)]
_BASES = (0xD1B54A32D192ED03, 0xAEF17502108EF2D9)
_powers = [(np.ones(1, dtype=_U), np.ones(1, dtype=_U)) for _ in _BASES]


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a hash base and of its inverse, modulo 2**64."""
    up, down = _powers[which]
    while len(up) <= n:
        m, im = (_U(pow(_BASES[which], sign * len(up), 1 << 64)) for sign in (1, -1))
        with np.errstate(over="ignore"):
            up, down = np.concatenate([up, up * m]), np.concatenate([down, down * im])
    _powers[which] = up, down
    return up, down


class Prefix:
    """Prefix sums from which the hash of any slice of a code sequence follows in O(1).

    which: one of two bases; the second also draws other codes, so that its hashes don't follow the first's."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        self.which = which
        codes = mix(codes + _U(0x632BE59BD9B4E019)) if which else codes
        p, _ = powers(len(codes), which)
        self.sums = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(codes * p[: len(codes)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        _, ip = powers(len(self.sums), self.which)
        return mix((self.sums[hi] - self.sums[lo]) * ip[lo] + (hi - lo).astype(_U) * _U(0x9E3779B97F4A7C15))


@dataclass
class Block:
    """Rows lo..hi of a batch; data is their texts' bytes, offsets (rows + 1) where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


@dataclass
class Words:
    """Words of a block: byte spans, hashes, owner row, and first[i]..first[i + 1] as the words of row i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive rows of a string column of about `size` bytes (one row at least); null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def words(block: Block, lower: bool = False) -> Words:
    data = block.data
    inside = np.frombuffer(data.tobytes().translate(_INSIDE), dtype=bool)
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] = inside[cuts]
    stop[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    codes = Prefix((_LOWER_CODE if lower else BYTE_CODE)[data]).of(start, end) if len(start) else np.zeros(0, dtype=_U)
    return Words(start, end, codes, np.searchsorted(start, block.offsets))


_GRAM = stream(2, 64)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of each run of n words within one row."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
    h = np.zeros(m, dtype=_U)
    for j in range(n):
        h += w.hash[j : j + m] * _GRAM[j]
    row = w.row
    ok = row[:m] == row[n - 1 :]
    return np.flatnonzero(ok), mix(h[ok])
