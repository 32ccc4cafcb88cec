"""Catalogue syncs and purges against rows written by hand."""

import pytest
from pyspark.sql import functions as F

from quillstream.operators import catalog_sync as S
from quillstream.operators import purge as P

FIELDS = ("name", "homepage_visible", "export_visible")
STORED = "id long, slug string, start_url string, lifecycle string, enabled boolean, managed boolean, origin string, kind string, name string, homepage_visible boolean, export_visible boolean, edited boolean"
WANTED = "slug string, start_url string, lifecycle string, position long, name string, homepage_visible boolean, export_visible boolean"


def stored(spark, *rows):
    """id, slug, path, lifecycle, managed, origin, name, edited."""
    full = [(i, slug, f"https://a.example/{path}", life, life == "active", managed, origin, "formal", name, True, True, edited) for i, slug, path, life, managed, origin, name, edited in rows]
    df = spark.createDataFrame(full, STORED)
    return df.withColumn("mark", F.when(F.col("managed"), F.when(F.col("edited"), "other").otherwise(S.mark(FIELDS)))).drop("edited")


def wanted(spark, *rows):
    return spark.createDataFrame([(slug, f"https://a.example/{path}", life, i, name, True, True) for i, (slug, path, life, name) in enumerate(rows)], WANTED)


def decided(w, s, **options):
    return {r.slug: (r.decision, r.id) for r in S.decisions(w, s, fields=FIELDS, **options).collect()}


ROWS = [
    (1, "same", "1", "active", True, "preset", "n", False), (2, "edited", "2", "active", True, "preset", "n", True), (3, "renew", "3", "paused", True, "preset", "old", False),
    (4, "rises", "4", "candidate", True, "preset", "n", False), (5, None, "5/", "active", False, "preset", "n", False), (6, "mine", "6", "active", False, "user_added", "n", False),
    (7, "other", "7", "active", True, "preset", "n", False), (8, "legacy-source-8", "8", "paused", False, "preset", "n", False), (9, "stays", "9", "active", True, "preset", "old", False), (10, "dropped", "10", "active", True, "preset", "n", False),
]
ENTRIES = [
    ("same", "1", "active", "n"), ("edited", "2", "active", "n"), ("renew", "3", "active", "new"), ("rises", "4", "active", "n"), ("five", "5", "active", "n"), ("mine", "6", "active", "n"),
    ("takes-seven", "7", "active", "n"), ("eight", "8", "candidate", "n"), ("stays", "9", "candidate", "new"), ("fresh", "11", "candidate", "n"),
]


def test_decisions_of_a_sync_and_of_a_forced_one(spark):
    s, w = stored(spark, *ROWS), wanted(spark, *ENTRIES)
    soft = decided(w, s)
    assert soft == {
        "same": ("existing", 1), "edited": ("conflict", 2), "renew": ("updated", 3), "rises": ("updated", 4), "five": ("conflict", 5), "mine": ("conflict", 6),
        "takes-seven": ("conflict", 7), "eight": ("conflict", 8), "stays": ("updated", 9), "fresh": ("created", None),
    }
    forced = decided(w, s, reconcile=True)
    # the edited row equals its entry: nothing is left to do
    assert forced == soft | {"edited": ("existing", 2), "five": ("updated", 5), "eight": ("updated", 8)}
    known = s.filter("id = 5").select(F.lit("five").alias("slug"), S.mark(FIELDS).alias("known_mark"))
    assert decided(w, s, known=known) == soft | {"five": ("updated", 5)}


def test_a_sync_keeps_what_was_set_by_hand(spark):
    s, w = stored(spark, *ROWS), wanted(spark, *ENTRIES)
    used = spark.createDataFrame([(7,), (7,)], "id long")
    soft = {r.slug or r.id: r for r in S.synced(w, s, used, fields=FIELDS).collect()}
    assert len(soft) == 11
    assert (soft["renew"].lifecycle, soft["renew"].enabled, soft["renew"].name) == ("paused", False, "new")
    assert (soft["stays"].lifecycle, soft["stays"].enabled, soft["stays"].name) == ("active", True, "new")
    assert (soft["rises"].lifecycle, soft["rises"].enabled) == ("active", True)
    assert (soft["fresh"].id, soft["fresh"].enabled, soft["fresh"].outcome) == (None, False, "created")
    forced = {r.slug: r for r in S.synced(w, s, used, True, fields=FIELDS).collect()}
    assert (forced["renew"].lifecycle, forced["stays"].lifecycle, forced["eight"].id, forced["five"].start_url) == ("active", "candidate", 8, "https://a.example/5")
    assert {k: r.outcome for k, r in forced.items() if k in ("other", "dropped", "mine")} == {"other": "retired", "dropped": "deleted", "mine": "kept"}
    gone = forced["other"]
    assert (gone.lifecycle, gone.enabled, gone.kind, gone.managed, gone.mark, gone.homepage_visible) == ("paused", False, "fallback", False, None, False)
    # what a sync leaves needs no second one; a row that equals its entry is left alone, with the mark it had
    left = S.synced(w, s, used, True, fields=FIELDS).filter("outcome <> 'deleted'").drop("outcome").withColumn("id", F.coalesce("id", F.lit(99).cast("long")))
    assert {d for d, _ in decided(w, left).values()} <= {"existing", "conflict"} and {k for k, (d, _) in decided(w, left).items() if d == "conflict"} == {"edited", "mine", "takes-seven"}


def test_aliases_shared_sources_and_empty_tables(spark):
    s = stored(spark, (1, None, "old", "active", False, "preset", "n", False), (2, "twice", "a", "active", True, "preset", "n", False), (3, "twice", "b", "active", True, "preset", "n", False))
    w = wanted(spark, ("moved", "new", "active", "n"), ("second", "newer", "active", "n"), ("twice", "b", "active", "n"))
    aliases = spark.createDataFrame([("moved", "https://a.example/old"), ("second", "https://a.example/old")], "slug string, start_url string")
    assert decided(w, s) == {"moved": ("created", None), "second": ("created", None), "twice": ("existing", 3)}
    assert decided(w, s, reconcile=True, aliases=aliases) == {"moved": ("updated", 1), "second": ("conflict", 1), "twice": ("existing", 3)}
    none, nobody = s.filter("false"), spark.createDataFrame([], "id long")
    assert {d for d, _ in decided(w, none).values()} == {"created"} and decided(w.filter("false"), s) == {}
    assert {r.outcome for r in S.synced(w.filter("false"), s, nobody, True, fields=FIELDS).collect()} == {"deleted"}
    empty = S.counters(S.decisions(w.filter("false"), none, fields=FIELDS), S.synced(w.filter("false"), none, nobody, fields=FIELDS).withColumn("implementation", F.lit("ready"))).first()
    assert set(empty.asDict().values()) == {0}


@pytest.fixture(scope="module")
def shop(spark):
    found = "array<struct<source_id: long, at: string>>"
    return {
        "sources": spark.createDataFrame([(1, "a", "https://x.example/1"), (2, "b", "HTTPS://X.example/2/?utm_source=m"), (3, None, None)], "id long, slug string, start_url string"),
        "items": spark.createDataFrame(
            [(10, 1, [(1, "p"), (2, "q"), (3, "r"), (1, "s")]), (11, 2, [(1, "p")]), (12, 3, [(2, "a"), (1, "b")]), (13, 3, None), (14, None, [(3, "z"), (None, "n"), (2, "y")]), (15, 3, []), (16, 3, [(2, "v"), (3, "w"), (2, "x")])],
            f"id long, source_id long, discoveries {found}",
        ),
        "executions": spark.createDataFrame([(100, 1), (100, 3), (101, 2), (101, 1), (102, 3)], "run_id long, source_id long"),
        "runs": spark.createDataFrame([(100,), (101,), (102,), (103,)], "id long"),
    }


def test_purges_take_sources_their_rows_and_their_mentions(spark, shop):
    slugs, urls = spark.createDataFrame([("a",), (None,)], "slug string"), spark.createDataFrame([("https://x.example/2",), (None,)], "start_url string")
    gone = P.retired(shop["sources"], slugs, urls)
    assert sorted(r.id for r in gone.collect()) == [1, 2]
    acts = spark.createDataFrame([(10,), (10,), (11,), (12,), (None,)], "item_id long")
    got = {r.id: (r["items"], r.revisions, r.reviews, r.executions, r.mentions, r.related) for r in P.plan(gone, shop["items"], shop["executions"], acts, acts.filter("item_id = 11")).collect()}
    assert got == {1: (1, 2, 0, 2, 4, 6), 2: (1, 1, 1, 1, 5, 7)}
    after = P.purged(gone=gone, **shop)
    assert [r.id for r in after["sources"].collect()] == [3] and sorted(r.id for r in after["runs"].collect()) == [100, 102, 103]
    items = {r.id: (None if r.discoveries is None else [x.at for x in r.discoveries], r.removed) for r in after["items"].collect()}
    assert items == {12: (None, 2), 13: (None, 0), 14: (["z", "n"], 1), 15: ([], 0), 16: (["w"], 2)}
    # source 1 goes first: what its item said of source 2 is no longer there to be cleaned
    assert P.counters(gone=gone, **shop).first().asDict() == {"deleted_sources": 2, "deleted_items": 2, "deleted_executions": 3, "deleted_empty_runs": 1, "cleaned_mentions": 8}


def test_purging_nothing_changes_nothing(spark, shop):
    none = shop["sources"].filter("false")
    assert set(P.counters(gone=none, **shop).first().asDict().values()) == {0}
    assert P.purged(gone=none, **shop)["items"].drop("removed").exceptAll(shop["items"]).isEmpty()
    assert P.plan(none, shop["items"], shop["executions"], shop["runs"].toDF("item_id"), shop["runs"].toDF("item_id")).isEmpty()
