"""Manual changes of stored items and sources, applied in batches with an audit trail.

A batch of changes holds one row an id and a column for each field it may set; null leaves the field as it is.
Ids that the store lacks change nothing and count as missing; of several rows for one id the last (by `seq`, which must
be distinct) holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions import text as T
from ..functions import urls as U


def latest(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def set_flag(store: DataFrame, changes: DataFrame, flag: str) -> DataFrame:
    """The store with a boolean column set by changes(id, seq, value)."""
    new = latest(changes).select("id", F.col("value").alias("_value"))
    return store.join(new, "id", "left").withColumn(flag, F.coalesce("_value", flag)).drop("_value")


def affected(store: DataFrame, changes: DataFrame) -> DataFrame:
    """How many requested rows found their item (an id asked for twice counts twice) and how many did not."""
    hits = changes.join(store.select("id", F.lit(True).alias("_found")), "id", "left")
    return hits.agg(F.count_if("_found").alias("affected"), F.count_if(F.col("_found").isNull()).alias("missing"))


def set_category(store: DataFrame, changes: DataFrame, actor: str = "web_manual_category") -> tuple[DataFrame, DataFrame]:
    """The store after changes(id, seq, category) and its audit rows; null or blank clears, an unknown category is refused and changes nothing."""
    valid = changes.withColumn("category", F.nullif(F.trim("category"), F.lit(""))).filter(F.col("category").isNull() | F.col("category").isin(D.CATEGORIES))
    new = latest(valid).select("id", F.col("category").alias("_category"), F.lit(True).alias("_hit"))
    both = store.join(new, "id", "left")
    as_json = lambda c: F.to_json(F.struct(F.col(c).alias("manual_category")), {"ignoreNullFields": "false"})
    audit = both.filter("_hit").select(F.col("id").alias("item_id"), F.lit(actor[:100]).alias("actor"), as_json("manual_category").alias("old_data"), as_json("_category").alias("new_data"))
    return both.withColumn("manual_category", F.when(F.col("_hit"), F.col("_category")).otherwise(F.col("manual_category"))).drop("_category", "_hit"), audit


def ordered_tags(tags: Column, domain: list[str]) -> Column:
    """Distinct tags in the order of their domain; null where one is outside it."""
    known = F.array(*[F.lit(x) for x in domain])
    return F.when(F.forall(tags, lambda t: F.array_contains(known, t)), F.filter(known, lambda t: F.array_contains(tags, t)))


REVIEW_FIELDS = ["manual_primary_type", "manual_topic_tags", "manual_industry_tags", "verification_status", "review_status", "official_url", "origin_publisher"]


def checked_review(changes: DataFrame) -> DataFrame:
    """changes with their values cleaned and `error`: the first field whose value is not valid, null if all are."""
    clean = {
        "manual_topic_tags": ordered_tags(F.col("manual_topic_tags"), D.TOPICS),
        "manual_industry_tags": ordered_tags(F.col("manual_industry_tags"), D.INDUSTRIES),
        "official_url": U.canonical_url(F.col("official_url")),
        "origin_publisher": T.collapse(F.col("origin_publisher")),
    }
    domains = {"manual_primary_type": D.PRIMARY_TYPES, "verification_status": D.VERIFICATION, "review_status": D.REVIEW}
    out = changes
    for c in REVIEW_FIELDS:
        out = out.withColumn(f"_{c}", clean.get(c, F.col(c)))

    def wrong(c: str) -> Column:
        if c in domains:
            return F.col(c).isNotNull() & ~F.col(c).isin(domains[c])
        bad = F.col(f"_{c}").isNull()
        if c == "origin_publisher":
            bad = F.coalesce(F.length(f"_{c}"), F.lit(0)).between(1, 500) == F.lit(False)
        return F.col(c).isNotNull() & bad

    out = out.withColumn("error", F.coalesce(*[F.when(wrong(c), F.lit(c)) for c in REVIEW_FIELDS]))
    return out.drop(*REVIEW_FIELDS).withColumnsRenamed({f"_{c}": c for c in REVIEW_FIELDS})


def review(store: DataFrame, changes: DataFrame, actor: str = "system_operator") -> tuple[DataFrame, DataFrame]:
    """The store after a taxonomy review and its audit rows (item_id, seq, actor, old_data, new_data as JSON).

    A status, once set by hand, is marked so that no later run replaces it; an official address marks the
    verification as well.  A change with an invalid value changes nothing and leaves no audit row.  Changes of one id
    apply in order of seq: each field takes its last value, and each change leaves an audit row of what it met and what it left."""
    ok = checked_review(changes).filter("error is null")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in REVIEW_FIELDS]
    both = store.join(ok.groupBy("id").agg(*newest), "id", "left")
    by_hand = {
        "verification_manually_set": F.col("verification_manually_set") | F.col("_verification_status").isNotNull() | F.col("_official_url").isNotNull(),
        "review_manually_set": F.col("review_manually_set") | F.col("_review_status").isNotNull(),
    }
    after = both.withColumns(by_hand | {c: F.coalesce(f"_{c}", c) for c in REVIEW_FIELDS}).drop(*[f"_{c}" for c in REVIEW_FIELDS])

    met = ok.select("id", "seq", *REVIEW_FIELDS).join(store.select("id", *[F.col(c).alias(f"_{c}") for c in REVIEW_FIELDS]), "id")
    so_far = Window.partitionBy("id").orderBy("seq")
    as_json = lambda last: F.to_json(F.struct(*[F.coalesce(F.last(c, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, last)), f"_{c}").alias(c) for c in REVIEW_FIELDS]), {"ignoreNullFields": "false"})
    return after, met.select(F.col("id").alias("item_id"), "seq", F.lit(actor[:100]).alias("actor"), as_json(-1).alias("old_data"), as_json(0).alias("new_data"))


def switch_sources(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """The sources after changes(id, seq, enabled), with `refused`: candidates and those that need a collector of their own can't be enabled."""
    new = latest(changes).select("id", F.col("enabled").alias("_enabled"))
    out = sources.join(new, "id", "left")
    refused = F.when(F.col("_enabled") & (F.col("lifecycle") == "candidate"), "candidate").when(F.col("_enabled") & (F.col("implementation") == "needs_custom_collector"), "needs_custom_collector")
    out = out.withColumn("refused", refused).withColumn("_set", F.col("_enabled").isNotNull() & F.col("refused").isNull())
    return (
        out.withColumn("lifecycle", F.when(F.col("_set"), F.when(F.col("_enabled"), "active").otherwise("paused")).otherwise(F.col("lifecycle")))
        .withColumn("enabled", F.when(F.col("_set"), F.col("_enabled")).otherwise(F.col("enabled")))
        .drop("_enabled", "_set")
    )
