"""Item filters, scopes, pages, overviews and top-k (Q-1 to Q-18, Q-36, Q-37)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import items as I
from . import fixtures as X
from .registry import query

READY = """(i.taxonomy_version <> 'v2' OR (i.verification_status IN ('official_confirmed', 'official_linked', 'multi_source_confirmed')
 AND i.review_status IN ('not_required', 'approved') AND i.primary_type NOT IN ('unclassified', 'industry_signal')
 AND (s.allowed_types = '' OR list_contains(string_split(s.allowed_types, ','), i.primary_type))))"""
FROM = X.WITH + "SELECT i.id, i.source_id FROM items i JOIN sources s ON i.source_id = s.id WHERE i.is_active AND "


def _filtered(name: str, wanted: I.ItemFilter, where: str) -> None:
    @query(name, FROM + where)
    def run(spark, d):
        return I.select_items(X.items(spark, d), X.sources(spark, d), wanted).select("id", "source_id")


_filtered("item_filter_keyword", I.ItemFilter(scope="all", keyword="THER"), "(contains(lower(i.title), 'ther') OR coalesce(contains(lower(i.summary), 'ther'), false))")
_filtered("item_effective_category", I.ItemFilter(scope="all", category="policy_industry"), "coalesce(i.manual_category, i.category) = 'policy_industry'")
_filtered("item_effective_primary_type", I.ItemFilter(scope="all", primary_type="report_release"), "coalesce(i.manual_primary_type, i.primary_type) = 'report_release'")
_filtered("item_equality_filters", I.ItemFilter(scope="all", verification="media_only", favorite=False, is_read=False), "i.verification_status = 'media_only' AND NOT i.favorite AND NOT i.is_read")
_filtered("item_unclassified_only", I.ItemFilter(scope="all", unclassified=True), "coalesce(i.manual_category, i.category) = 'unclassified'")
_filtered("item_unclassified_negation", I.ItemFilter(scope="all", unclassified=False), "NOT (coalesce(i.manual_category, i.category) = 'unclassified')")
_filtered(
    "item_half_open_range",
    I.ItemFilter(scope="all", published_from=datetime(2024, 1, 5), published_to=datetime(2024, 1, 20), discovered_from=datetime(2024, 2, 1, 2)),
    "i.published_at >= TIMESTAMP '2024-01-05' AND i.published_at < TIMESTAMP '2024-01-20' AND i.discovered_at >= TIMESTAMP '2024-02-01 02:00:00'",
)
_SHOWN = "s.enabled AND s.lifecycle = 'active' AND i.admission_accepted AND "
_filtered("item_scope_leadership", I.ItemFilter(), _SHOWN + "s.homepage_visible AND s.audience IN ('leadership', 'all') AND " + READY)
_filtered("item_scope_export", I.ItemFilter(scope="formal_export"), _SHOWN + "s.export_visible AND " + READY)
_filtered("item_scope_non_formal", I.ItemFilter(scope="non_formal"), "s.kind <> 'formal'")
_filtered("item_scope_disabled", I.ItemFilter(scope="disabled"), "NOT s.enabled")
_filtered("item_scope_fallback", I.ItemFilter(scope="fallback"), "s.kind = 'fallback'")
_filtered(
    "item_scope_leads",
    I.ItemFilter(scope="industry_leads"),
    "s.lifecycle = 'active' AND (i.primary_type = 'industry_signal' OR i.verification_status IN ('media_only', 'rumor_or_prediction') OR i.review_status = 'pending')",
)


@query("publication_ready", X.WITH + f"SELECT s.role, count(*) AS n, count(*) FILTER (WHERE {READY}) AS ready FROM items i JOIN sources s ON i.source_id = s.id GROUP BY s.role")
def publication_ready(spark, d):
    rows = I.with_source(X.items(spark, d), X.sources(spark, d))
    return rows.groupBy(F.col("s_role").alias("role")).agg(F.count(F.lit(1)).alias("n"), F.count_if(I.publication_ready()).alias("ready"))


@query("item_page_ordered", X.WITH + f"SELECT i.id, s.name, i.title FROM items i JOIN sources s ON i.source_id = s.id WHERE i.is_active ORDER BY {X.RECENT.replace('id', 'i.id')} LIMIT 20 OFFSET 40")
def item_page_ordered(spark, d):
    rows = I.select_items(X.items(spark, d), X.sources(spark, d), I.ItemFilter(scope="all"))
    return I.page(rows, 3, 20).select("id", F.col("s_name").alias("name"), "title")


@query("item_page_total", X.WITH + "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM items i JOIN sources s ON i.source_id = s.id WHERE i.is_active")
def item_page_total(spark, d):
    rows = I.select_items(X.items(spark, d), X.sources(spark, d), I.ItemFilter(scope="all"))
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", I.total_pages(F.col("total"), 20))


_DAY = (datetime(2024, 2, 1, 3), datetime(2024, 2, 1, 9))


@query(
    "item_overview",
    X.WITH
    + """SELECT count(*) AS total, count(*) FILTER (WHERE NOT is_read) AS unread,
    count(*) FILTER (WHERE discovered_at >= TIMESTAMP '2024-02-01 03:00:00' AND discovered_at < TIMESTAMP '2024-02-01 09:00:00') AS fresh,
    count(*) FILTER (WHERE coalesce(manual_category, category) = 'unclassified') AS unclassified FROM items WHERE is_active""",
)
def item_overview(spark, d):
    return I.overview(X.items(spark, d).filter("is_active"), *_DAY)


@query(
    "ai_work_overview",
    X.WITH + "SELECT count(*) FILTER (WHERE coalesce(manual_category, category) = 'unclassified') AS unclassified, count(*) FILTER (WHERE coalesce(ai_summary, '') = '') AS no_summary FROM items WHERE is_active",
)
def ai_work_overview(spark, d):
    return X.items(spark, d).filter("is_active").agg(F.count_if(I.unclassified()).alias("unclassified"), F.count_if(F.coalesce("ai_summary", F.lit("")) == "").alias("no_summary"))


@query(
    "recent_items_per_source_top5",
    X.WITH + f"SELECT source_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY {X.RECENT}) AS rank FROM items) WHERE rank <= 5",
)
def recent_items(spark, d):
    return I.top_per_key(X.items(spark, d), "source_id", 5, I.recency()).select("source_id", "id", "rank")


@query("count_by_source", X.WITH + "SELECT source_id, count(*) AS n FROM items GROUP BY source_id")
def count_by_source(spark, d):
    return X.items(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("revisions_per_source", X.WITH + "SELECT i.source_id, count(*) AS n FROM events e JOIN items i ON e.user_id = i.id GROUP BY i.source_id")
def revisions_per_source(spark, d):
    per_item = X.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return X.items(spark, d).join(per_item, "id").groupBy("source_id").agg(F.sum("k").alias("n"))


@query("thread_children", "SELECT p.conv_id, c.turn, c.role FROM conversations p JOIN conversations c ON p.conv_id = c.conv_id AND p.turn = 0 AND c.turn > 0")
def thread_children(spark, d):
    turns = X.table(spark, d, "conversations")
    parents = turns.filter("turn = 0").select("conv_id")
    return turns.filter("turn > 0").join(parents, "conv_id").select("conv_id", "turn", "role")


@query(
    "review_history",
    "SELECT user_id AS item_id, event_id, event_type AS actor, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_value FROM events",
)
def review_history(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return X.table(spark, d, "events").select(
        F.col("user_id").alias("item_id"), "event_id", F.col("event_type").alias("actor"), F.row_number().over(order).alias("pos"), F.lag("event_type").over(order).alias("old_value")
    )


@query(
    "ai_candidate_ids",
    X.WITH
    + "SELECT r.id, r.pos FROM (SELECT user_id AS id, min(event_id) AS pos FROM events GROUP BY user_id) r JOIN items i ON r.id = i.id WHERE i.is_active AND i.admission_accepted AND i.manual_category IS NULL ORDER BY r.pos LIMIT 100",
)
def ai_candidate_ids(spark, d):
    asked = X.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"))
    return I.candidate_ids(X.items(spark, d), asked, False).select("id", "pos")


@query("summarization_ids", X.WITH + "SELECT id FROM items WHERE is_active AND admission_accepted AND ai_summary IS NULL")
def summarization_ids(spark, d):
    return X.items(spark, d).filter("is_active AND admission_accepted AND ai_summary IS NULL").select("id")
