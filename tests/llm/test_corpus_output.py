"""Fill-in-the-middle, prefix tries and token files against brute force on small, awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillstream.llm.frames import Workspace


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")


def counter(rows):
    return collections.Counter(tuple(r) for r in rows)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def texts(n=150, seed=3):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice(["a", "é", "漢", "😀", " ", "\n", "\t", "<", "P>", "'s", "12", "Zug ", "\r\n", "　", "\0"]) for _ in range(k))
    return [None, "", "x", "😀", "a<P>b", "<S>", "<M", "\n", "<|endoftext|>", "a<|endoftext|>'re<|endo"] + [say(r.randint(1, 120)) for _ in range(n)] + ["same"] * 5


UNITS = {"chars": r"(?s).", "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "lines": r"[^\n]*\n|[^\n]+"}


def transformed(doc_id, text, unit):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    parts = re.findall(UNITS[unit], text)
    lo, hi = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    a, m, z = ("".join(p) for p in (parts[:lo], parts[lo:hi], parts[hi:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(parts), "plain", None, None, text
    if h4 % 100 < 20:
        return len(parts), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}"
    return len(parts), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}"


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_fill_in_middle(spark, unit):
    from quillstream.llm.fim import fill_in_middle, restored

    rows = [(i, t, "clash", 7) for i, t in enumerate(texts())] + [(None, "no id", "x", 1), (3, "😀", "clash", 7), (-5, "negative id", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    out = fill_in_middle(docs, unit)
    got = out.select("*", restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert counter(got) == counter((r[0], *transformed(r[0], r[1], unit), r[1] or "") for r in rows)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_fill_in_middle_long_text_and_string_ids(spark):
    from quillstream.llm.fim import fill_in_middle, restored

    long = "the quick 😀 fox\n" * 120_000
    docs = spark.createDataFrame([("a", long), ("b", long), (None, None)], "doc_id string, text string")
    got = fill_in_middle(docs).select("doc_id", "n", F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("h")).collect()
    assert counter(got) == counter([("a", len(long), sha(long)), ("b", len(long), sha(long)), (None, 0, sha(""))])


def brute_trie(turns):
    by = collections.defaultdict(list)
    for c, t, role, text, *_ in turns:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in by.items()}
    block = lambda c: c - int(c - 100 * int(c / 100))  # noqa: E731  toward zero
    paths = {c: own.get(block(c), [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}
    members, ended = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(paths):
        p = tuple(paths[c])
        ended[p].append(c)
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, ended[p])))) for p, m in members.items()]


TURNS = "conv_id long, turn long, role string, text string, depth int, seq string"


def turns_rows(seed, n):
    """Shared first turns, copies, prefixes of each other, ties, null turns, roles, texts and ids, repeated rows, absent blocks."""
    r = random.Random(seed)
    greetings, out = ["hello 😀", "hi", None, ""], []
    for c in [*range(0, n), *range(700, 720), -150, -100, -101, 10**12]:
        if c == 300:
            continue
        length = r.choice([1, 1, 2, 3, 5, 8, 12])
        style = r.random()
        for t in range(length):
            text = r.choice(greetings) if t < 2 or style < 0.4 else f"turn {r.randrange(4)}"
            out.append((c, None if r.random() < 0.03 else t, r.choice(["user", None]) if style > 0.8 else ("user", "assistant")[t % 2], text, 1, "x"))
    deep = [(5000 + k, t, "user", "long shared" if t < 30 else f"own {k}", 1, "x") for k in range(6) for t in range(30 + k % 3)]
    ties = [(6000, 0, "user", "b", 1, "x"), (6000, 0, "user", "a", 1, "x"), (6000, 0, "user", "a", 1, "x"), (None, 0, "user", "lost", 1, "x")]
    r.shuffle(out)
    return out + deep + ties + out[:3]


@pytest.mark.parametrize("least", [1, 8, 100_000])
def test_prefix_trie(spark, ws, least):
    """Every node and column, with groups parted at every branch, at some and at none."""
    from quillstream.llm.prefix_trie import prefix_trie, rebuilt

    rows = turns_rows(least, 320)
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    if least < 100_000:
        spark.conf.set("spark.sql.shuffle.partitions", "200")  # a partition's share is below `least`
    try:
        got = prefix_trie(rebuilt(turns, ws), ws, least_turns=least).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert counter(got) == counter(brute_trie(rows)) and len(got) > 500


def test_prefix_trie_small(spark, ws):
    from quillstream.llm.prefix_trie import prefix_trie, rebuilt

    trie = lambda rows: counter(prefix_trie(rebuilt(spark.createDataFrame(rows, TURNS), ws), ws).collect())
    assert not trie([])
    one = [(7, t, "user", "x" * 9, 0, "") for t in range(400)]  # its block is absent
    assert trie(one) == counter(brute_trie(one))
    lone = [(c, 0, "user", "gone", 0, "") for c in range(101, 110)]  # turnless where nothing is left
    assert trie(lone) == counter(brute_trie(lone))


def public():
    pytest.importorskip("tokenizers")
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_token_files(spark, ws, kind):
    import numpy as np
    import tokenizers

    from quillstream.llm.token_files import Reader, read_tokens, write_tokens

    lib = tokenizers.Tokenizer.from_file(public())
    name = (lambda i: i) if kind != "string" else (lambda i: f"d{i:05d}")
    rows = [(name(i), t, 1, "clash") for i, t in enumerate(texts())] + [(None, "no id", 1, "y"), (None, None, 1, "y"), (name(8), "another text of this id", 1, ""), (name(9), texts()[9], 1, "")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, start long, own string").repartition(4)
    manifest = write_tokens(docs, public(), 2, ws)
    got = sorted(read_tokens(manifest, kind).collect(), key=lambda r: r.start)
    ids = lambda t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
    want = collections.Counter((d, len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    order = [(r.doc_id is not None, r.doc_id or 0) if kind != "string" else (r.doc_id is not None, r.doc_id or "") for r in got]
    assert order == sorted(order)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sum(r.n_docs for r in manifest.collect()) == len(rows)
    again = {(r.doc_id, r.start, r.ids_crc32) for r in read_tokens(write_tokens(docs, public(), 2, ws), kind).collect()}
    assert again == {(r.doc_id, r.start, r.ids_crc32) for r in got}  # ties stand alike in every run
    file = Reader(max(manifest.collect(), key=lambda r: r.n_docs).path)
    k = file.index["doc_id"].to_pylist().index(next(d for d in file.index["doc_id"].to_pylist() if d is not None))
    assert any(np.array_equal(file.ids(k), ids(t)) for d, t, *_ in rows if d == file.index["doc_id"][k].as_py())


def test_token_files_empty(spark, ws):
    from quillstream.llm.token_files import read_tokens, write_tokens

    manifest = write_tokens(spark.createDataFrame([], "doc_id long, text string"), public(), 2, ws)
    assert manifest.count() == 0 and read_tokens(manifest).count() == 0


def test_long_texts_are_encoded_in_parts(spark, ws):
    import numpy as np
    import tokenizers

    from quillstream.llm.token_files import FRAME_IDS, LONG, Reader, read_tokens, write_tokens

    r = random.Random(9)
    long = "".join(r.choice(["word ", "é", "\n\n", "  ", "'ll ", "x1 ", "😀 "]) for _ in range(900_000))
    rows = [(1, long), (2, "x" * (LONG + 10)), (3, "short"), (4, long[:LONG] + "<|endoftext|>")]
    manifest = write_tokens(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), public(), 2, ws)
    lib = tokenizers.Tokenizer.from_file(public())
    ids = {d: np.array(lib.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for d, t in rows}
    assert len(ids[1]) > 2 * FRAME_IDS
    got = {x.doc_id: (x.n_tokens, x.ids_crc32) for x in read_tokens(manifest).collect()}
    assert got == {d: (len(i), zlib.crc32(i.tobytes())) for d, i in ids.items()}
    for m in manifest.collect():
        file = Reader(m.path)
        for k, d in enumerate(file.index["doc_id"].to_pylist()):
            assert np.array_equal(file.ids(k), ids[d])
            assert file.index["frames"][k].as_py() == -(-len(ids[d]) // FRAME_IDS)


def test_token_file_reads_only_what_is_asked_and_finds_damage(tmp_path):
    import numpy as np
    import zstandard

    import pyarrow as pa

    from quillstream.llm.token_files import Reader, Writer

    path = tmp_path / "f.zst"
    out = Writer(str(path))
    docs = [np.arange(k, 3 * k + 1, dtype="<u4") for k in range(50)]
    for k, d in enumerate(docs):
        out.add(k, iter([d[:k].tobytes(), d[k:].tobytes()]))
    assert out.close(pa.int64()) == (50, sum(map(len, docs)))
    with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as whole:  # any zstandard reader gets all ids
        assert whole.read() == b"".join(d.tobytes() for d in docs)
    raw = bytearray(path.read_bytes())
    file = Reader(str(path))
    at = int(file.at[7]) + 12
    raw[at] ^= 0xFF
    path.write_bytes(raw)
    file = Reader(str(path))
    assert np.array_equal(file.ids(6), docs[6]) and np.array_equal(file.ids(49), docs[49])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        file.ids(7)
