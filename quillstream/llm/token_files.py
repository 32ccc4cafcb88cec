"""Token ids on disk: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds the ids of some documents in order, each a little-endian unsigned 32-bit integer.  A document is
one frame, a long one several; no frame depends on another, so a reader decompresses only the documents that
it wants.  Behind the frames stand two skippable frames, which any zstandard reader passes over: an index of
documents (id, frames, ids, as an Arrow stream) and the seek table of the public seekable format, with the
compressed size, the size and the low 32 bits of XXH64 of each frame.

Files are written by tasks under names of their own and moved into place when complete; only the manifest,
which Spark commits, says which files count, so that lost or repeated tasks leave nothing that is read.

Defined results: a null or empty text has the end id alone; documents stand in ascending order of id, null
first, and rows that share an id by a hash of their text; ids are of any type that sorts; an empty table has
no file and an empty manifest; other columns of the input are ignored.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks
from .frames import Workspace, partitions, unused
from .token_counts import MEMO, SPECIAL, piece_starts

FRAME_IDS = 1 << 18  #: ids in a frame at most
LONG = 1 << 19  #: code points from which a text is encoded in parts
LEVEL = 3
ROW = 1000  #: new pieces encoded as one text
# Fixed values of the seekable format: skippable frames' magic numbers, the footer's, and the flag for checksums.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
MANIFEST = "shard long, path string, n_docs long, n_ids long"
_CUT = re.compile(r"(?<=\S) (?=\S)")


class Pieces(dict):
    """Ids of pre-tokens, as bytes, by their text; all of them come from the library."""

    def __init__(self, tokenizer_json: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(tokenizer_json)

    def learn(self, new: list[str]) -> None:
        """Letters behind a blank are one piece each also in a row, so that many are encoded as one text."""
        plain = [p for p in new if p[0] == " " and p[1:].isalpha()]
        rows = [plain[i : i + ROW] for i in range(0, len(plain), ROW)]
        rest = [p for p in new if not (p[0] == " " and p[1:].isalpha())]
        for row, found in zip(rows, self.library.encode_batch(["".join(r) for r in rows], add_special_tokens=False)):
            at = np.searchsorted(found.word_ids, np.arange(len(row) + 1)).tolist()
            if found.word_ids[-1] + 1 != len(row):
                rest += row
                continue
            ids = np.array(found.ids, dtype="<u4").tobytes()
            self.update((p, ids[4 * lo : 4 * hi]) for p, lo, hi in zip(row, at, at[1:]))
        for piece, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[piece] = np.array(found.ids, dtype="<u4").tobytes()

    def found(self, pieces: list[str]) -> list[bytes]:
        got = list(map(self.get, pieces))
        if None in got:
            new = list({p for p, g in zip(pieces, got) if g is None})
            if len(self) + len(new) > MEMO:
                self.clear()
                new = list(set(pieces))
            self.learn(new)
            got = [self[p] if g is None else g for p, g in zip(pieces, got)]
        return got

    def cut(self, text: str, first: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of texts that stand one after the other, and the first of each text."""
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.flatnonzero(piece_starts(cp, first[first < len(cp)]))
        at = [*starts.tolist(), len(cp)]
        return [text[a:b] for a, b in zip(at, at[1:])], np.searchsorted(starts, first)

    def many(self, text: str, first: np.ndarray) -> Iterator[bytes]:
        """The ids of each text; first says where they begin, with the end of the last."""
        pieces, bounds = self.cut(text, first)
        found, bounds = self.found(pieces), bounds.tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield b"".join(found[a:b])

    def whole(self, text: str) -> Iterator[bytes]:
        """The ids of one text in parts; special strings are single ids, as the library has it."""
        if SPECIAL in text:
            yield np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return
        lo = 0
        while lo < len(text):  # a blank between two words begins a piece, whatever stands elsewhere
            found = _CUT.search(text, lo + LONG)
            hi = found.start() if found else len(text)
            yield from self.many(text[lo:hi], np.array([0, hi - lo]))
            lo = hi


@lru_cache(2)
def library(path: str) -> Pieces:
    return Pieces(path)


def encoded(column: pa.Array, pieces: Pieces, end: int) -> Iterator[Iterator[bytes]]:
    """For each text its ids in parts, the end id last."""
    last = struct.pack("<I", end)
    for b in blocks(column):
        data = b.data.tobytes()
        if b.hi - b.lo == 1 and len(data) > LONG or SPECIAL.encode() in data:
            for i in range(b.hi - b.lo):
                yield _then(pieces.whole(b.text(i).decode("utf-8", "surrogatepass")), last)
            continue
        lead = np.concatenate([[0], np.cumsum((b.data & 0xC0) != 0x80)])
        for ids in pieces.many(data.decode("utf-8", "surrogatepass"), lead[b.offsets]):
            yield iter((ids, last))


def _then(parts: Iterator[bytes], last: bytes) -> Iterator[bytes]:
    yield from parts
    yield last


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """One file of documents, in the order of add()."""

    def __init__(self, path: str):
        import zstandard

        self.store, self.path = file_system(path)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.store.open_output_stream(f"{self.path}.part")
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list = []
        self.sizes: list[tuple[int, int]] = []

    def add(self, doc_id, parts: Iterator[bytes]) -> None:
        """A document from its ids in parts; memory holds one frame and one part."""
        first, total, pending = len(self.frames), 0, bytearray()
        for part in parts:
            pending += part
            while len(pending) > 4 * FRAME_IDS:
                self._frame(bytes(pending[: 4 * FRAME_IDS]))
                del pending[: 4 * FRAME_IDS]
            total += len(part) // 4
        self._frame(bytes(pending))
        self.ids.append(doc_id)
        self.sizes.append((len(self.frames) - first, total))

    def _frame(self, data: bytes) -> None:
        import xxhash

        packed = self.pack.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self, kind: pa.DataType) -> tuple[int, int]:
        """Ends the file and puts it into place; its documents and ids."""
        sizes = np.array(self.sizes, dtype=np.int64).reshape(-1, 2)
        index = pa.table({"doc_id": pa.array(self.ids, kind), "frames": sizes[:, 0].copy(), "n_ids": sizes[:, 1].copy()})
        payload = io.BytesIO()
        with pa.ipc.new_stream(payload, index.schema) as stream:
            stream.write_table(index)
        body = payload.getvalue()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body) + 4) + body + struct.pack("<I", len(body)))
        table = np.array(self.frames, dtype=ENTRY).tobytes()
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.frames), CHECKSUMS, FOOTER_MAGIC))
        self.out.close()
        self.store.move(f"{self.path}.part", self.path)
        return len(self.ids), int(sizes[:, 1].sum())


class Reader:
    """A file of documents: its index and seek table are read at once, frames when they are asked for."""

    def __init__(self, path: str):
        import zstandard

        store, where = file_system(path)
        self.file, self.unpack = store.open_input_file(where), zstandard.ZstdDecompressor()
        end = self.file.size()
        n, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{path} does not end in a seek table with checksums")
        end -= FOOTER.size + n * ENTRY.itemsize
        self.frames = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, end), dtype=ENTRY)
        end -= 8
        (size,) = struct.unpack("<I", self.file.read_at(4, end - 4))
        self.index = pa.ipc.open_stream(self.file.read_at(size, end - 4 - size)).read_all()
        self.at = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.index["frames"].to_numpy())])

    def __len__(self) -> int:
        return self.index.num_rows

    def parts(self, k: int) -> Iterator[bytes]:
        """The ids of the k-th document, a frame at a time, each held against its checksum."""
        import xxhash

        for i in range(int(self.first[k]), int(self.first[k + 1])):
            entry = self.frames[i]
            data = self.unpack.decompress(self.file.read_at(int(entry["packed"]), int(self.at[i])), max_output_size=int(entry["size"]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != entry["check"]:
                raise ValueError(f"frame {i} is damaged")
            yield data

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(k)), dtype="<u4")


def write_tokens(docs: DataFrame, tokenizer_json: str, end: int, ws: Workspace, name: str = "tokens") -> DataFrame:
    """Files of the ids of all documents, ascending by doc_id over files and within them; returns their manifest.

    The texts are dealt by ranges of (doc_id, hash of the text, place in the input), so that not even rows which
    share an id meet in one task, and sorted by Spark; a task holds one batch, one frame and its file's index."""
    root = f"{ws.root}/{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        path, out, kind = f"{root}/{shard:06d}-{uuid.uuid4().hex}.zst", None, None
        pieces = library(tokenizer_json)
        for batch in batches:
            if batch.num_rows and out is None:
                out, kind = Writer(path), batch.schema.field(0).type
            for doc_id, parts in zip(batch.column(0).to_pylist(), encoded(batch.column(1), pieces, end)):
                out.add(doc_id, parts)
        if out is not None:
            n_docs, n_ids = out.close(kind)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    place, own = unused(docs.select("doc_id", "text"), "place", "own")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias(own), F.monotonically_increasing_id().alias(place))
    dealt = keyed.repartitionByRange(partitions(docs.sparkSession), "doc_id", own, place).sortWithinPartitions("doc_id", own, place)
    return ws.save(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), f"{name}-manifest")


def read_tokens(manifest: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; one task reads whole files.

    The window runs over the manifest, one row a file."""
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                file = Reader(path)
                sizes, sums = np.zeros(len(file), dtype=np.int64), np.zeros(len(file), dtype=np.int64)
                for k in range(len(file)):
                    for part in file.parts(k):
                        sizes[k] += len(part) // 4
                        sums[k] = zlib.crc32(part, int(sums[k]))
                starts = start + np.concatenate([[0], np.cumsum(sizes)[:-1]])
                table = pa.table({"doc_id": file.index["doc_id"], "start": starts, "n_tokens": sizes, "ids_crc32": sums})
                yield from table.to_batches(max_chunksize=10_000)

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("path", before.alias("start")).repartition(partitions(manifest.sparkSession)).mapInArrow(run, schema)
