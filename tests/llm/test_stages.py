"""The pipeline's stages on awkward and very long documents against brute force, and the toxicity model against its definition."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, counter, linked

import corpus_pipeline
from quillstream.llm.frames import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, at int"
STAGES = dict(corpus_pipeline.STAGES)
ITEM = "the quick brown fox of the north jumps over eleven lazy dogs while nobody in the village is looking at them"


def awkward(seed=3):
    """Nulls in every column, empty texts, rows that repeat, ties, near copies, lines that repeat, and texts of some 100 kB."""
    r = random.Random(seed)
    say = lambda k: " ".join(f"w{r.randrange(4000)}" for _ in range(k))
    base, lines = say(60), [say(6) for _ in range(5)]
    long_ = "\n".join(say(12) for _ in range(4_000))
    texts = [
        None, "", " \n\t", base, base, base + " tail", base.replace(" ", "  "), "\n".join(lines), "\n".join(["intro line", *lines]), "\n".join([*lines[1:4], "x", *lines[1:4]]),
        say(40) + " " + ITEM + " " + say(9), ITEM.upper().replace("FOX", "FIX"), ITEM.replace("village", "xxxxxxxxxxxx"), ITEM[: len(ITEM) // 2], long_, long_ + " end", long_.replace("\n", " ") + " " + ITEM, "z" * 300_000, "\n".join(say(5) for _ in range(4)),
    ]
    rows = [(i, t, "en" if i % 4 else None, ("a", "b", None)[i % 3], len(t) if t is not None and i % 5 else None, "k", i) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[7], (None, base, None, None, None, None, None), (5, "another text under a known id, quite short", "en", "a", 1, None, 0)]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def short(rows):
    """Rows with their long texts as hashes, so that a difference can be read."""
    return counter(tuple(f"{len(x)}:{hash(x)}" if isinstance(x, str) and len(x) > 200 else x for x in r) for r in rows)


def test_lines_stage(spark, docs, rows, folder):
    places = collections.defaultdict(list)
    for d, t in {(r[0], r[1]) for r in rows}:
        lines = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
        for i in range(len(lines) - 2):
            places[tuple(x[1] for x in lines[i : i + 3])].append(((d is not None, d or 0), i, (d, t), [x[0] for x in lines[i : i + 3]]))
    gone = collections.defaultdict(set)
    for at in places.values():
        for p in sorted(at, key=lambda p: p[:2])[1:]:
            gone[p[2]] |= set(p[3])
    want = []
    for r in rows:
        text = "\n".join(x for i, x in enumerate((r[1] or "").split("\n")) if i not in gone[(r[0], r[1])])
        if WORD.search(text):
            want.append((r[0], text, *r[2:4], len(text), *r[5:]))
    got = STAGES["lines"](spark, docs, folder)
    assert got.columns == docs.columns and short(got.collect()) == short(want)
    assert sum(map(len, gone.values())) > 4_000


def test_near_duplicates_stage(spark, docs, rows, folder):
    """Of every group the smallest document stays; what is linked with nothing, nulls and repeated rows of a kept one stay too."""
    want = [r for r, (_, _, kept) in zip(rows, linked(rows), strict=True) if kept or r[0] is None]
    got = STAGES["near_duplicates"](spark, docs, folder)
    assert got.columns == docs.columns and short(got.collect()) == short(want)
    assert 3 <= len(rows) - len(want)


def test_decontaminate_stage(spark, docs, rows, folder):
    """A passage in a long text is found, as is one with other case and a letter changed; half of it and one with more edits are not."""
    held = re.compile(r"quick brown f[oi]x.*in the village is", re.I)
    want = [r for r in rows if not (r[1] and held.search(r[1]))]
    assert len(rows) - len(want) == 3
    got = STAGES["decontaminate"](spark, docs, folder)
    assert got.columns == docs.columns and short(got.collect()) == short(want)


def test_mixture_stage(spark, docs, rows, folder):
    """Ties, repeated rows and another order of rows change nothing; shares follow the sources' order, null last."""
    got = STAGES["mixture"](spark, docs, folder).collect()
    again = STAGES["mixture"](spark, docs.repartition(2, "text").orderBy(F.desc("doc_id")), folder).collect()
    assert counter(got) == counter(again) and len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    left, target = 1.5 * sum(sizes.values()), {}
    open_ = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (3, 1, 2), strict=True))
    while True:
        full = [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s], left = 2.0 * sizes[s], left - 2.0 * sizes[s]
        for s in full:
            del open_[s]
    target |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for x in got:
        assert x.target == pytest.approx(target[x.source]) and x.source_size == sizes[x.source]
        assert x.taken == x["copies"] * x["size"] <= 2 * x["size"]
    assert counter((x.doc_id, x["size"]) for x in got) == counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)


def test_quality_stage_keeps_long_texts(spark, docs, rows, folder):
    out = STAGES["quality"](spark, docs, folder)
    got = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert out.columns == docs.columns
    assert {14, 15, 16} <= set(got) and got[14].text == rows[14][1] and got[14].n_chars == len(rows[14][1])
    assert not {0, 1, 2, 17} & set(got)


def test_the_whole_pipeline_from_tables(spark, docs, folder):
    docs.drop("key", "at").write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert {3, 14} <= ids and not {0, 1, 2, 4, 5, 10, 11, 16, 17} & ids
    # line dedup leaves of document 15 the one line that 14 lacks, which is like no other text
    assert [r["size"] for r in got if r.doc_id == 15] == [13]
    assert all(r.taken == r["copies"] * r["size"] for r in got)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def grams_of(word: bytes):
    """Every byte and the end of a word, each with the four symbols before it; 256 stands for the border."""
    symbols = [256] * 4 + list(word) + [256]
    return [tuple(symbols[i - 4 : i + 1]) for i in range(4, len(symbols))]


def by_definition(counts, discount=0.75):
    """log p(toxic) - log p(ordinary) of a 5-gram, from its counts (ordinary, toxic) by gram, with shared lower orders."""
    levels = {5: set(counts)}
    for n in (4, 3, 2, 1):
        levels[n] = {g[1:] for g in levels[n + 1]}
    left = {n: collections.Counter(g[1:] for g in levels[n + 1]) for n in (4, 3, 2, 1)}

    def shared(g):
        if not g:
            return 1 / 257
        same = [x for x in levels[len(g)] if x[:-1] == g[:-1]]
        total = sum(left[len(g)][x] for x in same)
        return (max(left[len(g)][g] - discount, 0) + discount * len(same) * shared(g[1:])) / total

    def ratio(g):
        same = [x for x in counts if x[:-1] == g[:-1]]
        if not same:
            return 0.0
        logs = []
        for k in (0, 1):
            total, kinds = sum(counts[x][k] for x in same), sum(counts[x][k] > 0 for x in same)
            back = discount * kinds / total if total else 1.0
            p = max(counts[g][k] - discount, 0) / total if g in counts and total else 0.0
            logs.append(math.log(p + back * shared(g[1:])) if g in counts else math.log(back))
        return logs[1] - logs[0]

    return ratio


def test_toxicity_model_by_definition(spark):
    """The fitted n-gram ratios and the two features of new texts, words without evidence and bytes of other scripts included."""
    from quillstream.llm.blocks import blocks
    from quillstream.llm.toxicity import BITS, WORST, fit

    import pyarrow as pa

    r = random.Random(8)
    word = lambda bad: "".join(r.choice(["ka", "lo", "Mi", "é", "zug" if bad else "te"]) for _ in range(r.randint(1, 3)))
    texts = [(i, " ".join(word(i % 3 == 0) for _ in range(r.randint(1, 9))) + r.choice(["", " ka ka", "\tlo\n"])) for i in range(60)]
    docs, marks = spark.createDataFrame(texts + [(60, None), (61, "")], "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(62)], "doc_id long, toxic int")
    model = fit(docs, marks, Workspace(spark, "test"), F.lit(True))
    curve = {x.text for x in docs.filter(F.pmod(F.xxhash64("text"), F.lit(4)) == 0).collect()}
    toxic = collections.defaultdict(int)
    for i, t in texts:
        toxic[t] = max(toxic[t], int(i % 3 == 0))
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    counts = collections.defaultdict(lambda: [0, 0])
    for t, k in toxic.items():
        if t not in curve:
            for w in {w.encode().translate(lower) for w in WORD.findall(t)}:
                for g in grams_of(w):
                    counts[g][k] += 1
    counts = dict(counts)
    assert len(model.grams) == len(counts) > 50
    ratio = by_definition(counts)
    code = lambda g: sum(s << (int(BITS) * (4 - i)) for i, s in enumerate(g))
    every = sorted(counts) + [g[:-1] + (120,) for g in sorted(counts)[:40]] + [(1, 2, 3, 4, 5)]
    assert model.ratios(np.array([code(g) for g in every], dtype=np.uint64)) == pytest.approx([ratio(g) for g in every], abs=1e-9)
    new = ["ka zug LO", "", "qqq", "zugzug te ka mi é kalo", "ka ka"]
    for block in blocks(pa.array(new)):
        for t, (mean, worst) in zip(new[block.lo : block.hi], model.features(block).tolist(), strict=True):
            values = sorted(sum(map(ratio, grams_of(w.encode().translate(lower)))) for w in WORD.findall(t))
            assert mean == pytest.approx(sum(values) / len(values) if values else 0, abs=1e-9) and worst == pytest.approx(sum(values[-WORST:]) / WORST, abs=1e-9)
