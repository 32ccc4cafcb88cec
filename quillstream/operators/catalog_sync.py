"""Bringing a table of sources to what a catalogue wants (MUT-7, AGG-5), as joins over both tables.

wanted: slug, start_url (canonical), lifecycle, position (the entry's place in its catalogue) and `fields`.
stored: id, slug, start_url, lifecycle, enabled, managed, origin, kind, mark (see `mark`; of the last sync) and `fields`.

An entry's source is the stored row with its slug, else the one whose canonical address is its own, else the one that
`aliases` name for its slug; of several rows the one with the largest id.  Null slugs and addresses meet nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from .catalog import fingerprint
from .purge import one_row

FIELDS = ("name", "role", "tier", "audience", "policy", "implementation", "homepage_visible", "export_visible")
LEGACY = "legacy-source-"


def mark(fields: Sequence[str] = FIELDS) -> Column:
    """What tells whether somebody changed a row: the hash of its slug, address and fields, but not of its state."""
    return fingerprint({c: F.col(c) for c in ("slug", "start_url", *fields)})


def _latest(stored: DataFrame, key: Column) -> DataFrame:
    return stored.select(key.alias("_key"), "id").filter("_key IS NOT NULL").groupBy("_key").agg(F.max("id").alias("_id"))


def decisions(wanted: DataFrame, stored: DataFrame, reconcile: bool = False, aliases: DataFrame | None = None, known: DataFrame | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """wanted with id (of its source, null if there is none) and decision: created, updated, existing or conflict.

    A managed source that somebody changed since its last sync is a conflict, unless `reconcile`; one of the preset
    sources that is not managed yet is taken over only with `reconcile`, or where `known` (slug, known_mark) has its mark.
    aliases: slug, start_url (as stored) of sources under their earlier addresses.
    Of several entries that would take over one source the first by position does; those after it are conflicts."""
    slugs, urls = _latest(stored, F.col("slug")), _latest(stored, F.coalesce(canonical_url("start_url"), F.col("start_url")))
    rows = wanted.withColumn("_mark", mark(fields))
    rows = rows.join(slugs.toDF("_k1", "_by_slug"), F.col("slug") == F.col("_k1"), "left").join(urls.toDF("_k2", "_by_url"), F.col("start_url") == F.col("_k2"), "left")
    other = F.lit(None).cast("long")
    if aliases is not None:
        named = aliases.select(F.col("slug").alias("_k3"), F.col("start_url").alias("_u3")).join(stored.select(F.col("start_url").alias("_u4"), "id"), F.col("_u3") == F.col("_u4"))
        rows = rows.join(named.groupBy("_k3").agg(F.min("id").alias("_by_alias")), F.col("slug") == F.col("_k3"), "left")
        other = F.col("_by_alias")
    rows = rows.withColumn("id", F.coalesce("_by_slug", "_by_url", other))
    now = stored.withColumn("_now", mark(fields)).select(
        F.col("id").alias("_id"), F.col("slug").alias("_slug"), F.col("lifecycle").alias("_lifecycle"), F.col("enabled").alias("_enabled"), F.col("managed").alias("_managed"), F.col("origin").alias("_origin"), F.col("mark").alias("_stored_mark"), "_now"
    )
    rows = rows.join(now, F.col("id") == F.col("_id"), "left")
    safe = F.lit(False)
    if known is not None:
        rows = rows.join(known.select(F.col("slug").alias("_k5"), "known_mark"), F.col("slug") == F.col("_k5"), "left")
        safe = F.coalesce(F.col("known_mark") == F.col("_now"), F.lit(False))
    free = F.col("_slug").isNull() | F.startswith("_slug", F.lit(LEGACY))
    active = F.col("lifecycle") == "active"
    risen = (F.col("_lifecycle") == "candidate") & active
    astray = F.lit(reconcile) & ((F.col("_lifecycle") != F.col("lifecycle")) | (F.col("_enabled") != active))
    decision = (
        F.when(F.col("id").isNull(), "created")
        .when(~free & (F.col("_slug") != F.col("slug")), "conflict")
        .when(F.col("_managed") & F.lit(not reconcile) & ~F.col("_stored_mark").eqNullSafe(F.col("_now")), "conflict")
        .when(F.col("_managed") & (F.col("_now") == F.col("_mark")) & ~risen & ~astray, "existing")
        .when(F.col("_managed"), "updated")
        .when((F.col("_origin") == "preset") & (F.lit(reconcile) | safe), "updated")
        .otherwise("conflict")
    )
    takes = F.when(F.col("id").isNotNull() & (decision == "updated"), F.col("position"))
    rows = rows.withColumn("decision", decision).withColumn("_first", takes)
    first = rows.filter("_first IS NOT NULL").groupBy("id").agg(F.min("_first").alias("_least")).toDF("_owner", "_least")
    rows = rows.drop("_first").join(first, F.col("id") == F.col("_owner"), "left")
    return rows.withColumn("decision", F.when(F.col("position") > F.col("_least"), "conflict").otherwise(F.col("decision"))).select(*wanted.columns, "id", "decision", F.col("_mark").alias("mark"), F.col("_managed").alias("was_managed"))


def synced(wanted: DataFrame, stored: DataFrame, used: DataFrame, reconcile: bool = False, aliases: DataFrame | None = None, known: DataFrame | None = None, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The sources after the sync, deleted ones included: stored's columns and `outcome`.

    outcome: created (id null, the store numbers it), updated, retired or deleted (preset sources that no entry names,
    with `reconcile`; the ones in `used`, by id, are kept but paused and hidden), else kept.  A pause made by hand stays
    without `reconcile`, as does a managed source's activity where its entry is a candidate."""
    found = decisions(wanted, stored, reconcile, aliases, known, fields)
    taken = found.filter("decision = 'updated'").select(F.col("id").alias("_id"), F.struct("slug", "start_url", "lifecycle", "mark", "was_managed", *fields).alias("w"))
    rows = stored.join(taken, F.col("id") == F.col("_id"), "left")
    update = F.col("w").isNotNull()
    by_hand = F.lit(not reconcile)
    # an unmanaged source that is taken over keeps its pause, but not its activity
    state = (
        F.when(by_hand & (F.col("lifecycle") == "paused"), "paused")
        .when(by_hand & F.col("w.was_managed") & (F.col("lifecycle") == "active") & (F.col("w.lifecycle") == "candidate"), "active")
        .otherwise(F.col("w.lifecycle"))
    )
    new = {"slug": F.col("w.slug"), "start_url": F.col("w.start_url"), "lifecycle": state, "enabled": state == "active", "managed": F.lit(True), "origin": F.lit("preset"), "kind": F.lit("formal"), "mark": F.col("w.mark")} | {c: F.col(f"w.{c}") for c in fields}
    rows = rows.select("id", *[F.when(update, v).otherwise(F.col(c)).alias(c) for c, v in new.items()], F.when(update, "updated").otherwise("kept").alias("outcome"))
    if reconcile:
        names = wanted.select(F.col("slug").alias("_named")).distinct()
        rows = rows.join(names, F.col("slug") == F.col("_named"), "left").join(used.select(F.col("id").alias("_used")).distinct(), F.col("id") == F.col("_used"), "left")
        gone = F.col("_named").isNull() & (F.col("origin") == "preset")
        outcome = F.when(gone, F.when(F.col("_used").isNull(), "deleted").otherwise("retired")).otherwise(F.col("outcome"))
        hidden = {"enabled": F.lit(False), "lifecycle": F.lit("paused"), "kind": F.lit("fallback"), "homepage_visible": F.lit(False), "export_visible": F.lit(False), "managed": F.lit(False), "mark": F.lit(None).cast("string")}
        rows = rows.withColumn("outcome", outcome).withColumns({c: F.when(F.col("outcome") == "retired", v).otherwise(F.col(c)) for c, v in hidden.items()})
    fresh = found.filter("decision = 'created'").select(
        F.lit(None).cast("long").alias("id"), "slug", "start_url", "lifecycle", (F.col("lifecycle") == "active").alias("enabled"), F.lit(True).alias("managed"), F.lit("preset").alias("origin"), F.lit("formal").alias("kind"), "mark", *fields, F.lit("created").alias("outcome")
    )
    columns = ["id", *new, "outcome"]
    return rows.select(*columns).unionByName(fresh.select(*columns))


def counters(found: DataFrame, after: DataFrame) -> DataFrame:
    """One row of what a sync did: entries by decision, sources deleted and retired, and the state and implementation
    of the sources that the catalogue names, as they are afterwards.  found: `decisions`; after: `synced`."""
    entries = found.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("decision") == d).alias(n) for d, n in (("created", "created"), ("updated", "updated"), ("existing", "existing"), ("conflict", "conflicts"))]
    )
    names = found.select(F.col("slug").alias("_named")).distinct()
    rows = after.join(names, F.col("slug") == F.col("_named"), "left").withColumn("_in", F.col("_named").isNotNull() & (F.col("outcome") != "deleted"))
    kinds = ("ready", "needs_custom_collector", "blocked_by_javascript", "research_needed")
    sources = rows.agg(
        F.count_if(F.col("outcome") == "deleted").alias("deleted"), F.count_if(F.col("outcome") == "retired").alias("retired"),
        *[F.count_if(F.col("_in") & (F.col("lifecycle") == s)).alias(s) for s in ("active", "candidate", "paused")],
        *[F.count_if(F.col("_in") & (F.col("implementation") == s)).alias(s) for s in kinds],
    )
    return one_row([entries, sources])
