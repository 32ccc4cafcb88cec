"""The operators against brute force on small, awkward tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillstream.llm.frames import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, n_words string"


def corpus(n=60, seed=5):
    """Nulls, empties, repeats, ties, clashing extra columns, a long word and shared passages."""
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}x" for i in range(300)]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage, lines = say(90), [say(8) for _ in range(6)]
    texts = [None, "", " \n\t ", "one", "a b c d", "x" * 5000, "\n".join(lines), "\n".join(lines[1:] + [say(4)])]
    while len(texts) < n:
        k = r.random()
        base = say(r.randint(5, 200))
        texts.append(base if k < 0.4 else texts[-1] if k < 0.55 else f"{base} {passage}\t{say(20)}" if k < 0.8 else (texts[-1] or "q") + " end")
    rows = [(i, t, "en", f"src{i % 3}" if i % 5 else None, 0, True, "s", "n") for i, t in enumerate(texts)]
    return rows + [rows[-1], (None, "null id text here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")


def windows(seqs, n):
    seen = collections.Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - n + 1):
            if seen[tuple(s[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append(gone)
    return out


def counter(rows):
    return collections.Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("parts", [1, 4, 62])
def test_short_rows_beside_long_ones_change_no_hash(spark, rows, ws, parts):
    """A copy in a block of long texts only, the other in one that holds short texts too."""
    from quillstream.llm.substring import repeated_words
    from quillstream.llm.suffix_array import repeated_bytes

    long = " ".join(f"tok{i * 7919 % 10007}" for i in range(200_000))
    more = [*rows, (900, long, *rows[0][2:]), (901, long[5000:9000] + " end", *rows[0][2:]), (902, "q " + long[900_000:903_000], *rows[0][2:])]
    texts = [(r[1] or "") for r in more]
    docs = spark.createDataFrame(more, SCHEMA).coalesce(1) if parts == 1 else spark.createDataFrame(spark.sparkContext.parallelize(more, parts), SCHEMA)
    want = collections.Counter((r[0], sum(g)) for r, g in zip(more, windows([t.encode() for t in texts], 60)))
    assert collections.Counter((x.doc_id, x.n_removed) for x in repeated_bytes(docs, ws, 60).collect()) == want
    want = collections.Counter((r[0], sum(g)) for r, g in zip(more, windows([WORD.findall(t) for t in texts], 12)))
    assert collections.Counter((x.doc_id, x.n_removed) for x in repeated_words(docs, ws, 12).collect()) == want


@pytest.mark.parametrize("length", [400, 40])
def test_repeated_bytes(docs, rows, ws, length):
    from quillstream.llm.suffix_array import repeated_bytes

    texts = [(r[1] or "").encode() for r in rows]
    want = [
        (r[0], len(t), sum(g), sum(x and not y for x, y in zip(g, [False, *g])), hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest())
        for r, t, g in zip(rows, texts, windows(texts, length))
    ]
    got = repeated_bytes(docs, ws, length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert counter(got) == counter(want)


@pytest.mark.parametrize("length", [35, 6])
def test_repeated_words(docs, rows, ws, length):
    from quillstream.llm.substring import repeated_words

    texts = [WORD.findall(r[1] or "") for r in rows]
    want = [(r[0], len(t), sum(g), hashlib.sha256(" ".join(w for w, x in zip(t, g) if not x).encode()).hexdigest()) for r, t, g in zip(rows, texts, windows(texts, length))]
    assert counter(repeated_words(docs, ws, length).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == counter(want)


def test_quality_counts(docs, rows, ws):
    from quillstream.llm.quality import quality_rules

    want = []
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        repeat = sum(windows([w], 5)[0])
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)))
    got = quality_rules(docs, ws).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert counter(got) == counter(want)


def test_boilerplate(spark, ws):
    from quillstream.llm.quality import quality_rules

    rows = [(i, f"shared menu line of the site\nown {i} words {i * 7}", "h") for i in range(12)] + [(50, "shared menu line of the site\nshared menu line of the site and ten more words than that", "g")]
    got = {r.doc_id: (r.boiler_words, r.kept) for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), ws, min_left=0.5).collect()}
    assert got[0] == (6, False) and got[50][0] == 0


def boilerplate_rows():
    """Menu lines in several spellings, near the limit on either side, with copies, blank lines, nulls and repeated lines."""
    r = random.Random(11)
    menu = ["Home  News\tContact", "home news contact", " HOME NEWS CONTACT \r"]
    out = [(0, None, "h", 7, False), (1, "", "h", 7, False), (None, "home news contact\n" + "null id " * 8, "h", None, True), (2, "home news contact\n" * 9, "h", 7, True)]
    for i in range(3, 60):
        host = (None, "h", "g", "rare")[min(3, i % 5)]
        own = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 5))]
        lines = own + ([r.choice(menu)] * r.randint(1, 2) if host != "rare" or i < 9 else []) + (["", " \t"] if i % 2 else []) + (["all rights reserved"] if i % 4 == 0 else [])
        r.shuffle(lines)
        out.append((i, "\n".join(lines), host, 7, True))
    return out + [out[20], out[20], (90, out[20][1], out[20][2], 1, None), (91, out[20][1], "rare", 1, None)]


def without_boilerplate(rows, min_docs, max_share, min_left):
    """(row, words in boilerplate lines, kept, text without them) by brute force."""
    norm = lambda x: " ".join(WORD.findall(x.lower()))
    texts, holders = collections.defaultdict(set), collections.defaultdict(set)
    for d in rows:
        texts[d[2]].add(d[1])
        for x in (d[1] or "").split("\n"):
            if norm(x):
                holders[d[2], norm(x)].add(d[1])
    for d in rows:
        w, lines = WORD.findall(d[1] or ""), (d[1] or "").split("\n")
        bad = [norm(x) != "" and len(holders[d[2], norm(x)]) > max(min_docs, max_share * len(texts[d[2]])) for x in lines]
        n = sum(len(WORD.findall(x)) for x, b in zip(lines, bad) if b)
        kept = len(w) >= 10 and 100 * sum(windows([w], 5)[0]) <= 20 * len(w) and len(w) - n >= min_left * len(w)
        yield d, n, kept, "\n".join(x for x, b in zip(lines, bad) if not b) if any(bad) else d[1]


@pytest.mark.parametrize("min_docs,max_share", [(3, 0.02), (1, 0.5), (1000, 0.02)])
def test_boilerplate_lines_go(spark, ws, min_docs, max_share):
    from quillstream.llm.quality import passing, quality_rules

    rows = boilerplate_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept boolean").repartition(3)
    want = list(without_boilerplate(rows, min_docs, max_share, 0.3))
    assert (min_docs == 1000) == all(x[3] == x[0][1] for x in want if x[2])
    got = quality_rules(docs, ws, min_docs=min_docs, max_share=max_share).select("doc_id", "boiler_words", "kept", "text").collect()
    assert counter(got) == counter((d[0], n, kept, text) for d, n, kept, text in want)
    got = passing(docs, ws, min_docs=min_docs, max_share=max_share)
    assert got.columns == docs.columns and counter(got.collect()) == counter((d[0], text, *d[2:]) for d, n, kept, text in want if kept)


def test_quality_stage(spark):
    import corpus_pipeline

    rows = [(*d[:3], 0) for d in boilerplate_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = [(d[0], text, d[2], len(text)) for d, n, kept, text in without_boilerplate(rows, 10, 0.02, 0.3) if kept]
    assert any(x[1] != d[1] for x in want for d in rows if d[0] == x[0])
    assert counter(corpus_pipeline.quality(spark, docs, "").collect()) == counter(want)


def test_line_dedup(docs, rows, ws):
    from quillstream.llm.line_dedup import line_dedup

    keyed = {(r[0], r[1]): None for r in rows}
    occur = collections.defaultdict(list)
    for d, t in keyed:
        lines = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        for i in range(len(lines) - 2):
            occur[tuple(x[1] for x in lines[i : i + 3])].append(((d is not None, d or 0), i, (d, t), [x[0] for x in lines[i : i + 3]]))
    gone = collections.defaultdict(set)
    for places in occur.values():
        for p in sorted(places)[1:]:
            gone[p[2]] |= set(p[3])
    want = [(r[0], len(gone[(r[0], r[1])]), r[1] if not gone[(r[0], r[1])] else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone[(r[0], r[1])])) for r in rows]
    assert counter(line_dedup(docs, ws).select("doc_id", "n_removed", "text").collect()) == counter(want)


def test_near_duplicates(docs, rows, ws):
    from quillstream.llm.minhash import near_duplicates

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, root = {}, {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(lower))
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        root[r[0]] = r[0]

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [(r[0], len(sets[r[0]]), find(r[0]), find(r[0]) == r[0]) for r in rows]
    assert counter(near_duplicates(docs, ws).collect()) == counter(want)


def test_myers_and_matches(spark):
    from quillstream.llm.decontaminate import decontaminate, matches, myers

    r = random.Random(3)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(k)) for k in (r.randint(1, 9), r.randint(0, 25)))
        row = list(range(len(p) + 1))
        best = row[-1]
        for ch in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        assert min([len(p), *myers(p, t)]) == best
        assert list(myers(p, t, anchored=True))[-1:] == ([whole_edits(p, t)] if t else [])
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps all day long."
    rows = [(1, "x " * 50 + item.upper().replace(" ", "\n") + " y"), (2, "a " + item.replace("lazy", "lzy") + " b"), (3, item[:40]), (4, None), (5, ""), (2, "other text")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "short"), (None, item)], "item_id long, text string")
    assert sorted((m.doc_id, m.item_id, m.edits) for m in matches(docs, items).collect()) == [(1, 7, 0), (2, 7, 1)]
    assert sorted(x.doc_id for x in decontaminate(docs, items).collect()) == [2, 3, 4, 5]  # the clean row of doc_id 2 stays
    assert matches(docs, items.limit(0)).count() == 0


def whole_edits(p, t):
    row = list(range(len(p) + 1))
    for j, ch in enumerate(t, 1):
        new = [j]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != ch), row[i + 1] + 1, new[i] + 1))
        row = new
    return row[-1]


def fewest_edits(p, t):
    """Between p and any part of t that cuts no word."""
    free = lambda at: not (0 < at < len(t) and t[at - 1].isalnum() and t[at].isalnum())
    best = len(p) + 1
    for i in filter(free, range(len(t) + 1)):
        row = list(range(len(p) + 1))
        for j, ch in enumerate(t[i : i + 2 * len(p) + 2], i + 1):
            new = [j - i]
            for k, x in enumerate(p):
                new.append(min(row[k] + (x != ch), row[k + 1] + 1, new[k] + 1))
            row = new
            if free(j):
                best = min(best, row[-1])
    return best


def test_match_cuts_no_word(spark):
    from quillstream.llm.decontaminate import Matcher, border

    item = "was ist der kern davon?!"  # 24 characters, one edit
    m = Matcher([(1, item), (2, "cat"), (3, "新的模型能力评测")], 0.05)
    got = lambda t: sorted(x[:2] for x in m.match(t))
    assert got("x Was ist der Kern  davon?! y") == [(1, 0)] and got("was ist der kerm davon?!") == [(1, 1)] and got("was its der kern davon?!") == []
    assert got("xwas ist der kern davon?!") == [(1, 1)] and got("xxwas ist der kern davon?!") == []  # one letter more is an edit, two are a word cut
    assert got("a cat.") == [(2, 0)] and got("concatenate cats") == [] and got("猫cat猫") == [(2, 0)]
    assert got("全新的模型能力评测集") == [(3, 0)]
    assert border("ab", 0) and border("ab", 2) and not border("ab", 1) and border("a b", 1)


def test_matches_brute_force(spark):
    """Every text against every item, of 2 to 150 characters: within five percent of edits, and cutting no word."""
    from quillstream.llm.decontaminate import decontaminate, matches

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    items = [(f"i{k}", " ".join(word() for _ in range(r.choice([1, 3, 12, 25])))) for k in range(25)]

    def edited(t, n):
        for _ in range(n):
            at = r.randrange(len(t))
            t = t[:at] + r.choice(["", "z", t[at] + "y"]) + t[at + 1 :]
        return t

    texts = [" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(20)]
    texts += [f"{word()} {edited(t, r.randint(0, len(t) // 15))} {word()}" for _, t in items] + [f"q{t}{word()}" for _, t in items] + [None, ""]
    want = set()
    for i, t in enumerate(texts):
        for k, item in items:
            flat = " ".join((t or "").lower().split())
            if fewest_edits(item, flat) <= int(len(item) * 0.05):
                want.add((f"d{i}", k))
    docs = spark.createDataFrame([(f"d{i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, gone int")
    bench = spark.createDataFrame([*items, ("none", None), ("blank", " ")], "item_id string, text string")
    assert {(m.doc_id, m.item_id) for m in matches(docs, bench).collect()} == want and len(want) > 20
    assert {x.doc_id for x in decontaminate(docs, bench).collect()} == {f"d{i}" for i in range(len(texts))} - {d for d, _ in want}


def test_mix_rates(docs, ws):
    """Within a source all rates lie on one tilted curve, capped at 2, and meet the target; copies round them."""
    from quillstream.llm.mixing import mix

    by = collections.defaultdict(list)
    for x in mix(docs, ws).collect():
        by[x.source].append(x)
        assert x.taken == x.copies * x.size and x.copies in (math.floor(x.rate), math.ceil(x.rate))
    for rows_ in by.values():
        slopes = [math.log(x.rate) / x.size for x in rows_ if x.size and 0 < x.rate < 2 - 1e-6]
        assert not slopes or max(slopes) - min(slopes) < 1e-9
        assert sum(x.rate * x.size for x in rows_) == pytest.approx(rows_[0].target, rel=1e-6)


def test_mix(docs, rows, ws):
    from quillstream.llm.mixing import mix

    got = mix(docs, ws).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        for s in full or open_.copy():
            target[s] = 2 * sizes[s] if full else level * weight[s]
            open_.discard(s)
            left -= target[s] if full else 0
    taken = collections.Counter()
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in order)
    assert counter(mix(docs, ws).collect()) == counter(got)


def test_token_counts(docs, rows):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from quillstream.llm.token_counts import PrefixTokens, token_counts

    path = public.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    got = token_counts(docs, path).select("doc_id", "n_bytes", "n_tokens").collect()
    assert counter(got) == counter((r[0], len((r[1] or "").encode()), n(r[1])) for r in rows)
    enc = PrefixTokens(path)
    for t in ["it's  we'll  \n\n x", "a<|endoftext|>'re<|endo", "  ", "é漢字 12 'd'"]:
        assert enc.prefix_counts(t).tolist() == [n(t[:k]) for k in range(len(t) + 1)]
        assert enc.cut(t, 2) == max(k for k in range(len(t) + 1) if n(t[:k]) <= 2)


def interpolated(toks, fold, rounds=12):
    """Log10 probabilities by the definition, in plain Python."""
    from quillstream.llm.interpolation import BUCKETS, DELETED

    pairs = lambda t: zip([None, *t[:-1]], t, strict=True)
    bucket = lambda c: min(int(math.log2(c)) + 1, BUCKETS - 1) if c > 0 else 0

    def counts(keep):
        word, both, context = collections.Counter(), collections.Counter(), collections.Counter()
        for t, f in zip(toks, fold, strict=True):
            if keep(f):
                word.update(t), both.update(pairs(t)), context.update(v for v, _ in pairs(t))
        return word, both, context

    word, both, context = counts(lambda f: f > 0)
    n, v = sum(word.values()), len(word)
    rw, rb, rc = counts(lambda f: f > 0 and f != DELETED)
    kept = sum(rw.values())
    held = [(a, b) for t, f in zip(toks, fold, strict=True) if f == DELETED for a, b in pairs(t)]
    lam = [[0.4, 0.4, 0.2] for _ in range(BUCKETS)]
    lam[0] = [0.0, 0.8, 0.2]
    for _ in range(rounds):
        got = [[0.0] * 3 for _ in range(BUCKETS)]
        for a, b in held:
            k = bucket(rc[a])
            t = [lam[k][0] * (rb[a, b] / rc[a] if rc[a] else 0), lam[k][1] * rw[b] / max(kept, 1), lam[k][2] / (v + 1)]
            got[k] = [x + y / sum(t) for x, y in zip(got[k], t, strict=True)]
        old = [list(x) for x in lam]
        for k, g in enumerate(got):
            if sum(g):
                g = [max(x / sum(g), low) for x, low in zip(g, (0, 1e-6, 1e-6), strict=True)]
                lam[k] = [x / sum(g) for x in g]
        if max(abs(x - y) for p, q in zip(lam, old, strict=True) for x, y in zip(p, q, strict=True)) < 1e-4:
            break
    def score(a, b):
        l2, l1, l0 = lam[bucket(context[a])]
        return math.log10(l2 * (both[a, b] / context[a] if context[a] else 0) + l1 * word[b] / max(n, 1) + l0 / (v + 1))

    return [sum(score(a, b) for a, b in pairs(t)) for t in toks]


def test_interpolation(docs, rows, ws):
    from quillstream.llm.interpolation import interpolated_scores

    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [WORD.findall((r[1] or "").translate(lower)) + ["\0"] for r in rows]
    folds = [-1 if r[0] is None else zlib.crc32(str(r[0]).encode()) % 10 for r in rows]
    c = collections.Counter(w for t, f in zip(toks, folds) if f > 0 for w in t)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t) for t in toks]
    score = interpolated(toks, folds)
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = sorted(((r[0], f == 0, len(t), sum(c[w] > 0 for w in t), b, s) for r, f, t, b, s in zip(rows, folds, toks, base, score)), key=order)
    for head, passes in ((1 << 20, 1), (100, 3)):  # all counts at the workers, and some of them
        rows_ = interpolated_scores(docs, ws, fold, head=head, passes=passes).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows_), key=order)
        assert [g[:4] for g in got] == [w[:4] for w in want] and {r.train_tokens for r in rows_} == {n}
        for g, w in zip(got, want, strict=True):
            assert g[4] == pytest.approx(w[4], abs=1e-6) and g[5] == pytest.approx(w[5], rel=1e-5)


def test_toxicity(spark, ws):
    from quillstream.llm.toxicity import fit, score

    r = random.Random(1)
    word = lambda: "".join(r.choice(["on", "the", "er", "ing", "re"]) for _ in range(3))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(word() for _ in range(40)) + (f" zug{word()} kvab{word()} zug" if bad else "")))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "x")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = {x.doc_id: x for x in score(docs, fit(docs, marks, ws, fold != 2), fold == 2).collect()}
    held = [(x.predicted, dict(labels)[i]) for i, x in got.items() if x.held_out and i in dict(labels)]
    assert sum(p == y for p, y in held) >= 0.95 * len(held) and len(got) == len(rows) and 0 <= got[1000].score <= 1
    empty = score(docs, fit(docs, marks.limit(0), ws, fold != 2), fold == 2)
    assert {x.predicted for x in empty.collect()} == {0}


def test_empty_tables(spark, ws):
    from quillstream.llm import interpolation, line_dedup, minhash, mixing, quality, substring, suffix_array

    none = spark.createDataFrame([], SCHEMA)
    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    for out in (suffix_array.repeated_bytes(none, ws), substring.repeated_words(none, ws), quality.quality_rules(none, ws), line_dedup.line_dedup(none, ws), minhash.near_duplicates(none, ws), mixing.mix(none, ws), interpolation.interpolated_scores(none, ws, fold)):
        assert out.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        docs = out
    assert {"doc_id", "copies", "taken"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, d).columns)


def linked(rows, n=5, percent=75):
    """(doc_id, component_id, kept) of each row by brute force; a node is a text's set, its name the smallest id that has it."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    def shingles(t):
        w = WORD.findall((t or "").translate(lower))
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    sets = [shingles(r[1]) for r in rows]
    name = {}
    for r, s in zip(rows, sets):
        if s and r[0] is not None:
            name[s] = min(name.get(s, r[0]), r[0])
    group = {s: {s} for s in name}
    for a in name:
        for b in name:
            if group[a] is not group[b] and 100 * len(a & b) >= percent * len(a | b):
                both = group[a] | group[b]
                for s in both:
                    group[s] = both
    low = {s: min(name[x] for x in group[s]) for s in name}
    return [(r[0], low.get(s, r[0]) if r[0] is not None else None, r[0] == (low.get(s, r[0]) if r[0] is not None else None)) for r, s in zip(rows, sets)]


@pytest.mark.parametrize("kind,order", [("long", 1), ("long", 2), ("int", 3), ("string", 4)])
def test_near_duplicates_of_clashing_ids(spark, ws, kind, order):
    """Different texts under one id, equal texts under many, in several orders of rows and types of ids."""
    from quillstream.llm.minhash import keep_one, near_duplicates

    r = random.Random(order)
    say = lambda k: " ".join(f"w{r.randrange(900)}" for _ in range(k))
    a, b, c = say(40), say(40), say(60)
    texts = [(1, a), (2, b), (2, a + " two more"), (2, b), (3, b + " and one"), (9, c), (5, c + " end"), (5, say(30)), (4, None), (4, ""), (None, a), (7, "a b"), (8, "A b"), (8, "a b c"), (6, a)]
    name = (lambda i: i) if kind != "string" else (lambda i: i if i is None else f"d{i}")
    rows = [(name(i), t, "clash", 1) for i, t in texts]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, body string, id int").repartition(3)
    want = linked(rows)
    assert counter(near_duplicates(docs, ws).select("doc_id", "component_id", "kept").collect()) == counter(want)
    assert sum(not k for _, _, k in want) >= 5
    assert counter(keep_one(docs, ws).collect()) == counter(x for x, (_, _, k) in zip(rows, want) if k)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, ws, kind, rows):
    public = pytest.importorskip("public_tokenizers")
    from quillstream.llm import substring, suffix_array, token_counts, toxicity

    name = (lambda i: i) if kind == "int" else (lambda i: i if i is None else f"d{i}")
    docs = spark.createDataFrame([(name(r[0]), *r[1:3]) for r in rows], f"doc_id {kind}, text string, lang string").repartition(3)
    plain = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    path = public.path("byte_bpe_50k.json")
    for run in (lambda d: suffix_array.repeated_bytes(d, ws, 40), lambda d: substring.repeated_words(d, ws, 6), lambda d: token_counts.token_counts(d, path)):
        got, want = run(docs), run(plain)
        assert counter(got.collect()) == counter((name(x[0]), *x[1:]) for x in want.collect()) and dict(got.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]
    marks = spark.createDataFrame([(name(i), int(i % 4 == 0)) for i in range(40)], f"doc_id {kind}, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    got = toxicity.score(docs, toxicity.fit(docs, marks, ws, fold != 2), fold == 2)
    assert got.count() == len(rows) and dict(got.dtypes)["doc_id"] == dict(docs.dtypes)["doc_id"]


def test_empty_tables_of_the_rest(spark, ws):
    public = pytest.importorskip("public_tokenizers")
    from quillstream.llm import decontaminate, minhash, token_counts, toxicity

    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "an item of some length, which nothing holds")], "item_id long, text string")
    marks = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    for out in (decontaminate.matches(none, items), decontaminate.decontaminate(none, items), token_counts.token_counts(none, public.path("byte_bpe_50k.json")), toxicity.score(none, toxicity.fit(none, marks, ws, fold != 2), fold == 2), minhash.keep_one(none, ws)):
        assert out.count() == 0


def test_stages_without_documents(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0, name
