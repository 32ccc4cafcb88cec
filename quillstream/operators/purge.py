"""Purging retired sources: what would go, and the tables without it (MUT-8, AGG-6).

Items name the sources that found them in `discoveries`, an array of structs with source_id; purging a source removes
its own items and takes its name out of all others.  All steps are joins on ids; no list of ids leaves the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Counts that stand in one row each, beside each other: their union, summed."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns])


def retired(sources: DataFrame, slugs: DataFrame, urls: DataFrame) -> DataFrame:
    """The sources whose slug is in `slugs` or whose address, in canonical form where it has one, is in `urls`."""
    plain = lambda: F.coalesce(canonical_url("start_url"), F.col("start_url"))
    names = slugs.select(F.col("slug").alias("_slug")).distinct()
    places = urls.select(plain().alias("_url")).filter("_url IS NOT NULL").distinct()
    rows = sources.withColumn("_plain", plain()).join(names, F.col("slug") == F.col("_slug"), "left").join(places, F.col("_plain") == F.col("_url"), "left")
    return rows.filter(F.col("_slug").isNotNull() | F.col("_url").isNotNull()).select(*sources.columns)


def plan(gone: DataFrame, items: DataFrame, executions: DataFrame, revisions: DataFrame, reviews: DataFrame) -> DataFrame:
    """gone with the rows that go with each source: items, revisions and reviews of its items, executions, and its
    mentions among the discoveries of all items; related is the sum of revisions, reviews and mentions.

    items: id, source_id, discoveries; executions: source_id; revisions and reviews: item_id."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    owned = items.join(ids, F.col("source_id") == F.col("_gone"), "left_semi").select(F.col("id").alias("item_id"), "source_id")
    mentioned = items.select(F.explode("discoveries").alias("d")).select(F.col("d.source_id").alias("source_id"))
    counted = {
        "items": owned, "revisions": revisions.select("item_id").join(owned, "item_id"), "reviews": reviews.select("item_id").join(owned, "item_id"),
        "executions": executions.join(ids, F.col("source_id") == F.col("_gone"), "left_semi"), "mentions": mentioned.join(ids, F.col("source_id") == F.col("_gone"), "left_semi"),
    }
    out = gone
    for name, rows in counted.items():
        out = out.join(rows.groupBy(F.col("source_id").alias("_of")).agg(F.count(F.lit(1)).alias(name)), F.col("id") == F.col("_of"), "left").drop("_of")
    return out.na.fill(0, list(counted)).withColumn("related", F.col("revisions") + F.col("reviews") + F.col("mentions"))


def without_mentions(items: DataFrame, gone: DataFrame) -> DataFrame:
    """items with `removed`, the number of discoveries that named a source of gone, which are taken out; the order of the
    others stays, and what is left empty becomes null."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    named = items.select(F.col("id").alias("_item"), F.explode(F.array_distinct(F.transform("discoveries", lambda d: d["source_id"]))).alias("_named"))
    hit = named.join(ids, F.col("_named") == F.col("_gone"), "left_semi").groupBy("_item").agg(F.collect_set("_named").alias("_out"))
    rows = items.join(hit, F.col("id") == F.col("_item"), "left")
    left = F.filter("discoveries", lambda d: ~F.coalesce(F.array_contains("_out", d["source_id"]), F.lit(False)))
    changed = F.col("_out").isNotNull()
    rows = rows.withColumn("_left", F.when(changed, left).otherwise(F.col("discoveries")))
    rows = rows.withColumn("removed", F.when(changed, F.size("discoveries") - F.size("_left")).otherwise(0).cast("long"))
    return rows.withColumn("discoveries", F.when(~changed | (F.size("_left") > 0), F.col("_left"))).drop("_left", "_item", "_out")


def purged(sources: DataFrame, items: DataFrame, executions: DataFrame, runs: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The four tables afterwards: sources, items (with `removed`), executions and runs; a run goes if it had executions
    of a purged source and has none left."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    kept = executions.join(ids, F.col("source_id") == F.col("_gone"), "left_anti")
    touched = executions.join(ids, F.col("source_id") == F.col("_gone"), "left_semi").select(F.col("run_id").alias("_run")).distinct()
    empty = touched.join(kept.select(F.col("run_id").alias("_kept")).distinct(), F.col("_run") == F.col("_kept"), "left_anti")
    return {
        "sources": sources.join(ids, F.col("id") == F.col("_gone"), "left_anti"),
        "items": without_mentions(items.join(ids, F.col("source_id") == F.col("_gone"), "left_anti"), gone),
        "executions": kept,
        "runs": runs.join(empty, F.col("id") == F.col("_run"), "left_anti"),
    }


def counters(sources: DataFrame, items: DataFrame, executions: DataFrame, runs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: deleted_sources, deleted_items, deleted_executions, deleted_empty_runs and cleaned_mentions.

    Sources go by id, each after its mentions were cleaned: mentions in items that went before do not count."""
    ids = gone.select(F.col("id").alias("_gone")).distinct()
    names = items.select(F.col("source_id").alias("_of"), F.explode("discoveries").alias("d")).select("_of", F.col("d.source_id").alias("_named"))
    named = names.join(ids, F.col("_named") == F.col("_gone"), "left_semi").join(ids, F.col("_of") == F.col("_gone"), "left")
    left = purged(sources, items, executions, runs, gone)["runs"].select("id")
    lost = {
        "deleted_sources": sources.join(ids, F.col("id") == F.col("_gone"), "left_semi"),
        "deleted_items": items.join(ids, F.col("source_id") == F.col("_gone"), "left_semi"),
        "deleted_executions": executions.join(ids, F.col("source_id") == F.col("_gone"), "left_semi"),
        "deleted_empty_runs": runs.select(F.col("id").alias("_run")).join(left, F.col("_run") == F.col("id"), "left_anti"),
        "cleaned_mentions": named.filter(F.col("_gone").isNull() | (F.col("_of") >= F.col("_named"))),
    }
    return one_row([rows.agg(F.count(F.lit(1)).alias(name)) for name, rows in lost.items()])
