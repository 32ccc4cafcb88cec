"""Suffix dedup of byte strings from sampled suffixes, by recursion into shorter ranges.

Of all suffixes only sampled ones (one of about 64 bytes, chosen so that equal windows choose alike) become
tuples, each with hashes of its common prefix and of its whole span.  They are not sorted byte by byte: equal
prefixes meet by their hashes, in Spark's shuffles, aggregates and joins, which spill to disk and stand where the
method has priority queues; what lies between samples is induced by recursion into ever shorter ranges (see
repeats).  A task holds one Arrow block of texts, so shards may exceed memory.  The README gives the reasons.

Defined results: a null text is empty; a text under `length` bytes keeps everything; matches never cross
rows; a row that repeats another is a match for it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import BYTE_CODE, Block, blocks
from .frames import Workspace
from .repeats import id_column, Shape, covered, repeated_starts, spans_by_row, with_body


def byte_codes(block: Block) -> list[np.ndarray]:
    codes = BYTE_CODE[block.data]
    return [codes[a:b] for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]


def shape(length: int) -> Shape:
    sample = max(1, min(128, length // 3))
    return Shape(length, sample, min(8, length - sample + 1), tuple(x for x in (16, 1) if x < sample) or (1,))


def repeated_bytes(docs: DataFrame, ws: Workspace, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    rows = with_body(docs)
    marked = spans_by_row(rows, repeated_starts(rows, byte_codes, shape(length), ws))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                removed, runs, shas, kept = [], [], [], []
                for i in range(b.hi - b.lo):
                    data = b.data[b.offsets[i] : b.offsets[i + 1]]
                    gone = covered(len(data), batch.column(2)[b.lo + i], length)
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                    kept.append(data[~gone].tobytes())
                    shas.append(hashlib.sha256(kept[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(np.diff(b.offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return marked.mapInArrow(run, f"{id_column(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
