"""Source catalogue queries (Q-20 to Q-25, MUT-6 to MUT-8, AGG-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from . import fixtures as X
from .registry import query

VIEWS = {
    "monitoring": "enabled AND lifecycle = 'active'",
    "official": "tier IN ('government', 'official_company', 'association')",
    "media": "tier = 'authoritative_media'",
    "blocked": "implementation = 'blocked_by_javascript'",
    "needs_custom": "implementation = 'needs_custom_collector'",
}


@query("source_filter_catalog", X.WITH + " UNION ALL ".join(f"SELECT '{k}' AS view, id, name FROM sources WHERE (managed OR origin <> 'preset' OR kind <> 'fallback') AND {w}" for k, w in VIEWS.items()))
def source_filter_catalog(spark, d):
    rows = X.sources(spark, d).filter(C.visible())
    views = F.array_compact(F.array(*[F.when(C.catalog_filter(k), F.lit(k)) for k in VIEWS]))
    return rows.select(F.explode(views).alias("view"), "id", "name")


@query("source_search_page", X.WITH + "SELECT id, name, start_url FROM sources WHERE contains(lower(name), 'src1') OR contains(lower(start_url), 'src1') ORDER BY name, id LIMIT 5 OFFSET 5")
def source_search_page(spark, d):
    return C.search(X.sources(spark, d), "SRC1", 2, 5).select("id", "name", "start_url")


@query("source_options", X.WITH + "SELECT id, name FROM sources WHERE managed AND lifecycle = 'active'")
def source_options(spark, d):
    return C.options(X.sources(spark, d))


@query("source_selection", X.WITH + "SELECT id, enabled AND kind = 'formal' AS formal FROM sources WHERE enabled AND lifecycle <> 'candidate'")
def source_selection(spark, d):
    return X.sources(spark, d).filter("enabled AND lifecycle <> 'candidate'").select("id", (F.col("enabled") & (F.col("kind") == "formal")).alias("formal"))


@query(
    "source_overview",
    X.WITH + "SELECT count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE NOT enabled) AS disabled, count(*) FILTER (WHERE last_error IS NOT NULL OR NOT enabled) AS attention FROM sources",
)
def source_overview(spark, d):
    return C.overview(X.sources(spark, d))


_PREVIEW = """SELECT source_id, count(*) AS items, avg(CASE WHEN length(title) >= 20 THEN 1.0 ELSE 0.0 END) AS title_ratio, avg(CASE WHEN id % 9 <> 0 THEN 1.0 ELSE 0.0 END) AS link_ratio,
avg(CASE WHEN published_at IS NOT NULL THEN 1.0 ELSE 0.0 END) AS date_ratio, 1.0 - count(DISTINCT title) * 1.0 / count(*) AS duplicate_ratio, count(*) FILTER (WHERE NOT is_active) AS bad FROM items GROUP BY source_id"""


@query(
    "activation_gate",
    X.WITH
    + f""", preview AS ({_PREVIEW}) SELECT s.id, CASE WHEN s.lifecycle <> 'candidate' THEN 'not_a_candidate' WHEN s.implementation = 'needs_custom_collector' THEN 'collector_unsupported'
    WHEN s.implementation = 'blocked_by_javascript' THEN 'blocked' WHEN p.items < 1 THEN 'no_items' WHEN p.title_ratio < 0.8 THEN 'titles_missing' WHEN p.link_ratio < 0.8 THEN 'links_missing'
    WHEN p.date_ratio < 0.7 AND s.id % 2 = 1 THEN 'dates_missing' WHEN p.duplicate_ratio > 0.2 THEN 'too_many_duplicates' WHEN p.bad > 3 THEN 'failures' END AS reason
    FROM sources s JOIN preview p ON s.id = p.source_id""",
)
def activation_gate(spark, d):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    preview = X.items(spark, d).groupBy(F.col("source_id").alias("id")).agg(
        F.count(F.lit(1)).alias("items"), share(F.length("title") >= 20).alias("title_ratio"), share(F.col("id") % 9 != 0).alias("link_ratio"), share(F.col("published_at").isNotNull()).alias("date_ratio"),
        (1.0 - F.count_distinct("title") / F.count(F.lit(1))).alias("duplicate_ratio"), F.greatest(F.lit(0), F.count_if(~F.col("is_active")) - 3).alias("failures"),
    )
    rows = X.sources(spark, d).join(preview, "id").withColumn("date_fallback", F.col("id") % 2 == 0)
    return rows.select("id", C.activation_reason().alias("reason"))


_WANTED = "SELECT slug, CASE WHEN id % 9 = 4 THEN 'https://host0.example/src0' ELSE start_url END AS start_url, CASE WHEN id % 4 = 0 THEN 'new' ELSE 'same' END AS hash FROM sources WHERE id % 5 <> 0"
_STORED = "SELECT slug, start_url, 'same' AS hash, id % 2 = 0 AS used FROM sources WHERE id % 7 <> 3"


@query(
    "catalog_reconcile",
    X.WITH
    + f""", wanted AS ({_WANTED}), stored AS ({_STORED}) SELECT coalesce(w.slug, s.slug) AS slug, CASE WHEN w.slug IS NULL THEN CASE WHEN s.used THEN 'retire' ELSE 'delete' END
    WHEN o.slug IS NOT NULL AND o.slug <> w.slug THEN 'conflict' WHEN s.slug IS NULL THEN 'create' WHEN w.hash <> s.hash THEN 'update' ELSE 'unchanged' END AS decision
    FROM wanted w LEFT JOIN stored o ON w.start_url = o.start_url FULL OUTER JOIN stored s ON w.slug = s.slug""",
)
def catalog_reconcile(spark, d):
    rows = X.sources(spark, d)
    url = F.when(F.col("id") % 9 == 4, "https://host0.example/src0").otherwise(F.col("start_url"))
    wanted = rows.filter("id % 5 <> 0").select("slug", url.alias("start_url"), F.when(F.col("id") % 4 == 0, "new").otherwise("same").alias("hash"))
    stored = rows.filter("id % 7 <> 3").select("slug", "start_url", F.lit("same").alias("hash"), (F.col("id") % 2 == 0).alias("used"))
    return C.reconcile(wanted, stored)


@query(
    "purge_impact",
    X.WITH
    + """SELECT s.id, (SELECT count(*) FROM items i WHERE i.source_id = s.id) AS items, (SELECT count(*) FROM executions e WHERE e.source_id = s.id) AS executions,
    (SELECT count(*) FROM events e JOIN items i ON e.user_id = i.id WHERE i.source_id = s.id) AS revisions FROM sources s""",
)
def purge_impact(spark, d):
    revisions = X.table(spark, d, "events").select(F.col("user_id").alias("item_id"))
    return C.purge_impact(X.sources(spark, d), X.items(spark, d), X.executions(spark, d), revisions)


@query(
    "purge_empty_runs",
    X.WITH
    + "SELECT id FROM runs r WHERE EXISTS (SELECT 1 FROM executions e WHERE e.run_id = r.id AND e.source_id % 2 = 0) AND NOT EXISTS (SELECT 1 FROM executions e WHERE e.run_id = r.id AND e.source_id % 2 <> 0)",
)
def purge_empty_runs(spark, d):
    retired = X.executions(spark, d).select(F.col("source_id").alias("id")).distinct().filter("id % 2 = 0")
    return C.after_purge(X.runs(spark, d), X.executions(spark, d), retired).select("id")


_PRINTED = ["slug", "name", "start_url", "enabled", "tier", "last_error"]


@query("source_fingerprints", X.WITH + "SELECT id, sha256(concat('{', " + ", ',', ".join(f"'\"{c}\":', coalesce(CAST(to_json({c}) AS VARCHAR), 'null')" for c in sorted(_PRINTED)) + ", '}')) AS mark FROM sources")
def source_fingerprints(spark, d):
    return X.sources(spark, d).select("id", C.fingerprint({c: F.col(c) for c in _PRINTED}).alias("mark"))
