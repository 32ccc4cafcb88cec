"""Substring dedup of word sequences: token k-mers, compacted along paths that do not branch.

Token k-mers (k = the window) are the edges of a De Bruijn graph, which is never written down: a sampled
(k - 1)-overlap routes each run of consecutive edges with one minimiser, a super-k-mer, to one key.  Where all
runs of a key are the same the path does not branch and is one unitig at once; where they differ, Spark joins
cut the path at its branches and compact the parts, down to single edges (see repeats).  Source coordinates go
along with every path; equal paths are told by 128 bits, not by reading the source again.

Defined results: a null text has no words; a text of fewer than `length` words keeps everything; a row that
repeats another is a match for it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, blocks, words
from .frames import Workspace
from .repeats import id_column, Shape, covered, repeated_starts, spans_by_row, with_body


def word_codes(block: Block) -> list[np.ndarray]:
    w = words(block)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def shape(length: int) -> Shape:
    sample = max(1, min(24, length * 2 // 3))
    return Shape(length, sample, min(4, length - sample + 1), (1,))


def repeated_words(docs: DataFrame, ws: Workspace, length: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words joined by blanks) of every row."""
    rows = with_body(docs)
    marked = spans_by_row(rows, repeated_starts(rows, word_codes, shape(length), ws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                total, removed, shas, kept = [], [], [], []
                for i in range(b.hi - b.lo):
                    tokens = b.text(i).split()
                    gone = covered(len(tokens), batch.column(2)[b.lo + i], length)
                    total.append(len(tokens))
                    removed.append(int(gone.sum()))
                    if removed[-1]:
                        tokens = [t for t, g in zip(tokens, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(tokens))
                    shas.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return marked.mapInArrow(run, f"{id_column(docs)}, n_words long, n_removed long, kept_sha256 string, kept string")
