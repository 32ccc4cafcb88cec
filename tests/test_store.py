"""The item store against a fold over rows in plain Python."""

import hashlib
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream.operators import store as S
from quillstream.operators import upsert as P
from quillstream.plans import registry
from quillstream.streaming.ingest import ingest_items

T0 = datetime(2025, 1, 1)
FIELDS = ["seq", "run_id", "run_at", "source_id", "source_name", "canonical_url", "original_url", "fingerprint", "parent_fingerprint", "title", "summary", "published_at", "extra", "category", "primary_type", "verification_status", "review_status"]
TYPES = {c: S.BATCH[c] for c in FIELDS}
SCHEMA = ", ".join(f"{c} {t}" for c, t in TYPES.items())
CONTENT = ["title", "summary", "published_at", "extra"]


def rows(seed, n=260, runs=3):
    """Runs over few addresses and fingerprints, so that everything hits everything."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        run = i * runs // n + 1
        mark = lambda: r.choice([None, *(f"{k:064d}" for k in range(30))])
        source = r.choice([1, 1, 2, 3]) if r.random() > 0.02 else None
        url = f"https://h.example/{r.randrange(60)}" if r.random() > 0.02 else None
        when = None if r.random() < 0.3 else T0 + timedelta(days=r.randrange(3), microseconds=r.choice([0, 120]))
        out.append((i, run, T0 + timedelta(hours=run), source, f"s{run}", url, f"{url}?x", mark(), mark() if r.random() < 0.4 else None, f"t{r.randrange(3)}", r.choice([None, "s", ""]), when, r.choice([None, '{"a":1}']),
                    r.choice(["unclassified", "award_case"]), r.choice([None, "product_update"]), r.choice([None, "unverified", "official_linked"]), r.choice([None, "pending"])))
    return out


class Fold:
    """What persisting one row after the other does; runs and sources as they come."""

    def __init__(self):
        self.items, self.urls, self.marks, self.done, self.revisions, self.outcomes = {}, {}, {}, set(), [], []

    def add(self, values):
        x = dict(zip(FIELDS, values))
        if None in (x["source_id"], x["canonical_url"]):
            self.outcomes.append((x["seq"], None, "invalid"))
            return
        mark = (x["source_id"], x["fingerprint"])
        at = self.urls.get(x["canonical_url"]) or (self.marks.get(mark) if x["fingerprint"] else None)
        parent = self.marks.get((x["source_id"], x["parent_fingerprint"])) if x["parent_fingerprint"] else None
        if at is None:
            at = self.urls[x["canonical_url"]] = x["canonical_url"]
            if x["fingerprint"]:
                self.marks[mark] = at
            self.items[at] = {c: x[c] for c in ("source_id", "canonical_url", "original_url", "fingerprint", *CONTENT, "category", "primary_type", "verification_status", "review_status")}
            self.items[at] |= {"discovered_at": x["run_at"], "last_seen_at": x["run_at"], "parent": parent, "seen": {}, "manual_category": None, "vset": False, "rset": False}
            outcome = "new"
        elif (at, x["run_id"], x["source_id"]) in self.done:
            self.outcomes.append((x["seq"], at, "in_batch_duplicate"))
            return
        else:
            item, outcome = self.items[at], "skipped"
            item["last_seen_at"] = x["run_at"]
            if item["source_id"] != x["source_id"]:
                first = item["seen"].get(x["source_id"], (None, x["run_at"]))[1]
                item["seen"][x["source_id"]] = (x["source_name"], first, x["run_at"])
            else:
                changed = [c for c in CONTENT if item[c] != x[c]]
                if changed:
                    self.revisions.append((at, x["run_id"], tuple(changed)))
                    outcome = "updated"
                item |= {c: x[c] for c in (*CONTENT, "category")}
                item["primary_type"] = x["primary_type"] or item["primary_type"]
                item["verification_status"] = x["verification_status"] if x["verification_status"] and not item["vset"] else item["verification_status"]
                item["review_status"] = x["review_status"] if x["review_status"] and not item["rset"] else item["review_status"]
                item["parent"] = parent or item["parent"]
        self.done.add((at, x["run_id"], x["source_id"]))
        self.outcomes.append((x["seq"], at, outcome))


def state(items):
    out = {}
    for r in items.collect():
        seen = {d.source_id: (d.source_name, d.first_seen_at, d.last_seen_at) for d in r.discoveries}
        assert list(seen) == sorted(seen)
        out[r.canonical_url] = {c: r[c] for c in ("source_id", "canonical_url", "original_url", "fingerprint", *CONTENT, "category", "primary_type", "verification_status", "review_status", "discovered_at", "last_seen_at", "manual_category")} | {"seen": seen, "parent": r.parent_item_id}
    return out


def wanted(fold, spark):
    ids = {r.u: r.i for r in spark.createDataFrame([(u,) for u in fold.items], "u string").select("u", S.item_id(F.col("u")).alias("i")).collect()}
    return {u: {k: v for k, v in x.items() if k not in ("vset", "rset", "parent")} | {"parent": ids.get(x["parent"])} for u, x in fold.items.items()}


def test_store_is_a_fold(spark, tmp_path):
    """Two batches of three runs, a run parted between them, against rows one by one; then both once more."""
    data, fold = rows(1), Fold()
    for x in data:
        fold.add(x)
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=5)
    frame = lambda part: spark.createDataFrame(part, SCHEMA).repartition(3)
    for part in (data[:120], data[120:]):
        store.persist(frame(part))
    assert state(store.items()) == wanted(fold, spark)
    ids = {r.canonical_url: r.item_id for r in store.items().collect()}
    assert sorted((r.seq, r.item_id, r.outcome) for r in store.outcomes().collect() if r.outcome != "invalid") == sorted((n, ids[u], o) for n, u, o in fold.outcomes if o != "invalid")
    assert {o for _, _, o in fold.outcomes} == {"new", "updated", "skipped", "in_batch_duplicate", "invalid"}
    assert sorted((r.item_id, r.run_id, tuple(r.f)) for r in store.revisions().select("item_id", "run_id", F.json_object_keys("new_data").alias("f")).collect()) == sorted((ids[u], n, f) for u, n, f in fold.revisions)
    assert store.version() == 2 and store.items(1).count() < store.items().count()


def test_a_batch_twice_is_as_good_as_once(spark, tmp_path):
    """Inserts, updates and hits by other sources, each address with a fingerprint of its own."""
    tame = [x[:7] + (f"{x[5]}", None) + x[9:] for x in rows(2) if x[5]]
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=5)
    for part in (tame[:120], tame[120:]):
        store.persist(spark.createDataFrame(part, SCHEMA))
    before, n = state(store.items()), store.revisions().count()
    assert n > 10 and any(x["seen"] for x in before.values())
    store.persist(spark.createDataFrame(tame[120:], SCHEMA))
    assert state(store.items()) == before and store.revisions().count() == n and store.version() == 3


def test_flags_set_by_hand_hold(spark, tmp_path):
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=2)
    row = lambda seq, run, status, review, url="https://h.example/1": (seq, run, T0 + timedelta(hours=run), 1, "s", url, url, str(seq), None, "t", None, None, None, "award_case", None, status, review)
    store.persist(spark.createDataFrame([row(1, 1, "unverified", "pending"), row(2, 1, "unverified", "pending", "https://h.example/2")], SCHEMA))
    held = store.items().withColumn("verification_manually_set", F.col("canonical_url").endswith("1")).withColumn("manual_category", F.lit("irrelevant"))
    store.replace(held)
    store.persist(spark.createDataFrame([row(3, 2, "official_linked", "reviewed"), row(4, 2, "official_linked", None, "https://h.example/2")], SCHEMA))
    got = {r.canonical_url[-1]: (r.verification_status, r.review_status, r.manual_category) for r in store.items().collect()}
    assert got == {"1": ("unverified", "reviewed", "irrelevant"), "2": ("official_linked", "pending", "irrelevant")}
    assert {r.category for r in store.outcomes().filter("run_id = 2").collect()} == {"irrelevant"}


def test_an_interrupted_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=3)
    data = rows(4, 80, 2)
    store.persist(spark.createDataFrame(data[:40], SCHEMA))
    before = state(store.items())
    write = store._write
    monkeypatch.setattr(store, "_write", lambda out, kind, *a: 1 / 0 if kind == "outcomes" else write(out, kind, *a))
    with pytest.raises(ZeroDivisionError):
        store.persist(spark.createDataFrame(data[40:], SCHEMA))
    monkeypatch.undo()
    assert store.version() == 1 and state(store.items()) == before
    store.persist(spark.createDataFrame(data[40:], SCHEMA))
    fold = Fold()
    for x in data:
        fold.add(x)
    assert state(store.items()) == wanted(fold, spark)


@pytest.mark.parametrize("cuts", [[0, 37, 260], [0, 60, 61, 150, 260]])
def test_stream_is_the_same_however_it_is_cut(spark, tmp_path, cuts):
    data = rows(7)
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(data[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=4)
    ingest_items(read(), store, "s", f"{tmp_path}/cp").awaitTermination()
    whole = S.ItemStore(spark, f"file://{tmp_path}/whole", buckets=7)
    whole.persist(spark.createDataFrame(data, SCHEMA))
    assert state(store.items()) == state(whole.items())
    was = store.version()
    ingest_items(read(), store, "s", f"{tmp_path}/cp2").awaitTermination()  # a stream that lost its checkpoint comes again
    assert store.version() == was and store.outcomes().count() == len(data)


def test_empty_batch_and_counters(spark, tmp_path):
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=3)
    assert store.items().count() == 0 and store.persist(spark.createDataFrame([], SCHEMA)).count() == 0 and store.items().count() == 0
    rows_ = spark.createDataFrame([("new", "unclassified"), ("updated", "x"), ("skipped", "unclassified"), ("in_batch_duplicate", None), ("invalid", None)], "outcome string, category string")
    assert tuple(P.counters(rows_).first()) == (1, 1, 2, 2, 2)


def test_insert_if_absent(spark):
    stored = spark.createDataFrame([(1, "a")], "k int, v string")
    got = S.insert_if_absent(spark.createDataFrame([(1, "x"), (2, "c"), (2, "b")], "k int, v string"), stored, "k").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b")]


def test_parts_of_the_buckets_are_as_good_as_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 1)
    test_store_is_a_fold(spark, tmp_path)
    assert sorted(os.listdir(f"{tmp_path}/store")) == ["items", "manifest", "outcomes", "prints", "revisions"]


def test_long_fingerprints_are_told_apart(spark, tmp_path):
    """Long ones that differ late, and one that looks like the short form of another."""
    long = [f"{k:0200d}" for k in range(3)]
    marks = [*long, *(f"#{hashlib.sha256(x.encode()).hexdigest()}" for x in long), None]
    r, fold = random.Random(5), Fold()
    data = [x[:7] + (r.choice(marks), None) + x[9:] for x in rows(5, 60, 2)]
    for x in data:
        fold.add(x)
    store = S.ItemStore(spark, f"file://{tmp_path}/store", buckets=2)
    for part in (data[:25], data[25:]):
        store.persist(spark.createDataFrame(part, SCHEMA))
    assert state(store.items()) == wanted(fold, spark)


def test_a_batch_leaves_no_copies_of_its_texts(spark, tmp_path):
    """Neither checkpoints nor shuffle files: on disk stands what the store holds."""
    r, n, size = random.Random(6), 300, 20_000
    text = lambda: "".join(r.choices("abcdefghijklmnop", k=size))
    batch = lambda run: spark.createDataFrame([(run * n + i, run, T0, i % 3, f"https://h.example/{i}", f"{i}", text()) for i in range(n)], "seq long, run_id long, run_at timestamp, source_id long, canonical_url string, fingerprint string, summary string")
    batches, store = [batch(1), batch(2)], S.ItemStore(spark, f"file://{tmp_path}/store", buckets=3)
    P.checkpointed(spark.range(1))
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    folders.append(spark.sparkContext.getCheckpointDir().removeprefix("file:"))

    def held():
        files = [os.path.join(d, f) for top in folders for d, _, names in os.walk(top) for f in names]
        return sum(os.path.getsize(f) for f in files if os.path.exists(f))

    before = held()
    for x in batches:
        store.persist(x)
    until = time.time() + 30  # shuffle files go a little later
    while held() - before > n * size // 2 and time.time() < until:
        time.sleep(0.5)
    assert held() - before <= n * size // 2
    assert store.revisions().count() == n and store.items().filter(F.length("summary") == size).count() == n


@pytest.mark.parametrize("name", ["store_revisions", "store_run_counters"])
def test_a_query_leaves_its_store_only(spark, name):
    """No checkpoints of the batches, no intermediate tables, and texts in small files."""
    P.checkpointed(spark.range(1))
    shared, checkpoints = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {*os.listdir(shared)}, {*os.listdir(checkpoints)}
    registry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert {*os.listdir(checkpoints)} == before[1]
    (store,) = {*os.listdir(shared)} - before[0]
    assert sorted(os.listdir(f"{shared}/{store}")) == ["items", "manifest", "outcomes", "prints", "revisions"]
    files = [f for _, _, names in os.walk(f"{shared}/{store}") for f in names if f.endswith(".parquet")]
    assert files and all(".zstd." in f for f in files)
