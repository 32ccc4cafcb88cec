"""Sources: filters, overview, activation gate, reconciliation and purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFICIAL = ["government", "official_company", "association"]


def visible() -> Column:
    return F.col("managed") | (F.col("origin") != "preset") | (F.col("kind") != "fallback")


def catalog_filter(kind: str) -> Column:
    """Named catalogue views."""
    table = {
        "monitoring": F.col("enabled") & (F.col("lifecycle") == "active"),
        "candidate": F.col("lifecycle") == "candidate",
        "paused": F.col("lifecycle") == "paused",
        "official": F.col("tier").isin(OFFICIAL),
        "media": F.col("tier") == "authoritative_media",
        "blocked": F.col("implementation") == "blocked_by_javascript",
        "needs_custom": F.col("implementation") == "needs_custom_collector",
    }
    return table[kind]


def search(sources: DataFrame, keyword: str | None, number: int = 1, per_page: int = 20) -> DataFrame:
    if keyword:
        word = F.lower(F.lit(keyword))
        sources = sources.filter(F.contains(F.lower("name"), word) | F.contains(F.lower("start_url"), word))
    return sources.orderBy("name", "id").offset((number - 1) * per_page).limit(per_page)


def options(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("managed") & (F.col("lifecycle") == "active")).orderBy("name", "id").select("id", "name")


def overview(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("enabled").alias("enabled"),
        F.count_if(~F.col("enabled")).alias("disabled"),
        F.count_if(F.col("last_error").isNotNull() | ~F.col("enabled")).alias("attention"),
    )


def activation_reason() -> Column:
    """The first gate that a candidate's preview fails, null if it may become active."""
    return (
        F.when(F.col("lifecycle") != "candidate", "not_a_candidate")
        .when(F.col("implementation") == "needs_custom_collector", "collector_unsupported")
        .when(F.col("implementation") == "blocked_by_javascript", "blocked")
        .when(F.col("items") < 1, "no_items")
        .when(F.col("title_ratio") < 0.8, "titles_missing")
        .when(F.col("link_ratio") < 0.8, "links_missing")
        .when((F.col("date_ratio") < 0.7) & ~F.col("date_fallback"), "dates_missing")
        .when(F.col("duplicate_ratio") > 0.2, "too_many_duplicates")
        .when(F.col("failures") > 0, "failures")
    )


def reconcile(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """slug and decision: create, conflict (its address belongs to another slug), update, unchanged, delete (never
    used) or retire.  Both sides have slug, start_url and hash; stored also has used."""
    urls = stored.select(F.col("start_url").alias("u"), F.col("slug").alias("owner"))
    w = wanted.join(urls, F.col("start_url") == F.col("u"), "left").select("slug", "hash", "owner")
    s = stored.select(F.col("slug").alias("old"), F.col("hash").alias("old_hash"), "used")
    both = w.join(s, F.col("slug") == F.col("old"), "full_outer")
    decision = (
        F.when(F.col("slug").isNull(), F.when(F.col("used"), "retire").otherwise("delete"))
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("slug")), "conflict")
        .when(F.col("old").isNull(), "create")
        .when(F.col("hash") != F.col("old_hash"), "update")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce("slug", "old").alias("slug"), decision.alias("decision"))


def purge_impact(sources: DataFrame, items: DataFrame, executions: DataFrame, revisions: DataFrame) -> DataFrame:
    """What goes with each source: items, executions, revisions of its items."""
    n = lambda rows, name: rows.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    owned = revisions.groupBy("item_id").agg(F.count(F.lit(1)).alias("k")).join(items.select(F.col("id").alias("item_id"), "source_id"), "item_id")
    out = sources.select("id").join(n(items, "items"), "id", "left").join(n(executions, "executions"), "id", "left")
    out = out.join(owned.groupBy(F.col("source_id").alias("id")).agg(F.sum("k").alias("revisions")), "id", "left")
    return out.na.fill(0, ["items", "executions", "revisions"])


def after_purge(runs: DataFrame, executions: DataFrame, retired: DataFrame) -> DataFrame:
    """Runs that would have no execution left once the retired sources' ones are gone."""
    gone = executions.join(retired.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("run_id").distinct()
    left = executions.join(retired.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("run_id")
    return runs.join(gone.withColumnRenamed("run_id", "id"), "id", "left_semi").join(left.withColumnRenamed("run_id", "id"), "id", "left_anti")


def fingerprint(fields: dict[str, Column]) -> Column:
    """The hash of a row's fields: of their JSON without blanks, keys in order, nulls included, in UTF-8.

    The order in which the fields are given makes no difference.  Times count by their wall clock, as ISO text."""
    iso = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"}
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), iso), 256)
