"""The item query layer: a filter value compiled to one Column, scopes, order, pages and overviews."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D

TRUSTED = ["official_confirmed", "official_linked", "multi_source_confirmed"]


def effective(manual: str, automatic: str) -> Column:
    """A manual value wins over the automatic one."""
    return F.coalesce(F.col(manual), F.col(automatic))


def allowed_type(types: Column, value: Column) -> Column:
    """An empty list of allowed types allows all."""
    return (types == "") | F.array_contains(F.split(types, ","), value)


def publication_ready() -> Column:
    trusted = F.col("verification_status").isin(TRUSTED)
    reviewed = F.col("review_status").isin("not_required", "approved")
    typed = ~F.col("primary_type").isin("unclassified", "industry_signal")
    return (F.col("taxonomy_version") != "v2") | (trusted & reviewed & typed & allowed_type(F.col("s_allowed_types"), F.col("primary_type")))


def scope_filter(scope: str) -> Column:
    """An unknown scope counts as leadership."""
    shown = F.col("s_enabled") & (F.col("s_lifecycle") == "active") & F.col("admission_accepted")
    if scope == "formal_export":
        return shown & F.col("s_export_visible") & publication_ready()
    if scope == "all":
        return F.lit(True)
    if scope == "non_formal":
        return F.col("s_kind") != "formal"
    if scope == "disabled":
        return ~F.col("s_enabled")
    if scope == "fallback":
        return F.col("s_kind") == "fallback"
    if scope == "industry_leads":
        lead = (F.col("primary_type") == "industry_signal") | F.col("verification_status").isin("media_only", "rumor_or_prediction") | (F.col("review_status") == "pending")
        return (F.col("s_lifecycle") == "active") & lead
    return shown & F.col("s_homepage_visible") & F.col("s_audience").isin(D.AUDIENCES) & publication_ready()


def unclassified() -> Column:
    """Null-safe, so that its negation keeps rows without a manual category."""
    return effective("manual_category", "category").eqNullSafe("unclassified")


@dataclass(frozen=True)
class ItemFilter:
    scope: str = "leadership"
    keyword: str | None = None
    category: str | None = None
    primary_type: str | None = None
    verification: str | None = None
    review: str | None = None
    source_id: int | None = None
    favorite: bool | None = None
    is_read: bool | None = None
    published_from: datetime | None = None
    published_to: datetime | None = None
    discovered_from: datetime | None = None
    discovered_to: datetime | None = None
    unclassified: bool | None = None

    def column(self) -> Column:
        """A conjunction; ranges are half open and drop rows without a date."""
        tests = [F.col("is_active"), scope_filter(self.scope)]
        if self.keyword:
            word = F.lower(F.lit(self.keyword))
            tests.append(F.contains(F.lower("title"), word) | F.coalesce(F.contains(F.lower("summary"), word), F.lit(False)))
        if self.category:
            tests.append(effective("manual_category", "category") == self.category)
        if self.primary_type:
            tests.append(effective("manual_primary_type", "primary_type") == self.primary_type)
        for name, value in (("verification_status", self.verification), ("review_status", self.review), ("source_id", self.source_id), ("favorite", self.favorite), ("is_read", self.is_read)):
            if value is not None:
                tests.append(F.col(name) == value)
        for name, low, high in (("published_at", self.published_from, self.published_to), ("discovered_at", self.discovered_from, self.discovered_to)):
            if low is not None:
                tests.append(F.col(name) >= F.lit(low))
            if high is not None:
                tests.append(F.col(name) < F.lit(high))
        if self.unclassified is not None:
            tests.append(unclassified() if self.unclassified else ~unclassified())
        return reduce(and_, tests)


def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items with their source's attributes as s_*; the planner broadcasts sources while they are small."""
    renamed = sources.select(*[F.col(c).alias(f"s_{c}") for c in sources.columns])
    return items.join(renamed, F.col("source_id") == F.col("s_id"))


def select_items(items: DataFrame, sources: DataFrame, wanted: ItemFilter) -> DataFrame:
    return with_source(items, sources).filter(wanted.column())


def recency() -> list[Column]:
    return [F.coalesce("published_at", "discovered_at").desc(), F.col("id").desc()]


def page(rows: DataFrame, number: int, per_page: int) -> DataFrame:
    return rows.orderBy(*recency()).offset((number - 1) * per_page).limit(per_page)


def total_pages(total: Column, per_page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / per_page))


def overview(rows: DataFrame, since: datetime, until: datetime) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if((F.col("discovered_at") >= F.lit(since)) & (F.col("discovered_at") < F.lit(until))).alias("fresh"),
        F.count_if(unclassified()).alias("unclassified"),
    )


def top_per_key(rows: DataFrame, key: str, k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each key, k held to 1..20, with their rank; row_number <= k prunes before the shuffle."""
    k = max(1, min(20, k))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def candidate_ids(items: DataFrame, requested: DataFrame, only_unclassified: bool, cap: int = 100) -> DataFrame:
    """Requested (pos, id) that may go to a language model: first request of each id, in request order, `cap` at most."""
    first = requested.groupBy("id").agg(F.min("pos").alias("pos"))
    ok = F.col("is_active") & F.col("admission_accepted") & F.col("manual_category").isNull()
    if only_unclassified:
        ok = ok & (F.col("category") == "unclassified")
    return first.join(items.filter(ok).select("id"), "id").orderBy("pos").limit(cap)
