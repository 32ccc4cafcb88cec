"""Queries of the intake operators (FN-7, FN-23, UPS-7, UPS-9, TAX-6, TAX-11, AGG-2, AGG-5, AGG-7, PIPE-3, PIPE-4, PIPE-6, SINK-9, Q-19, Q-35, Q-38, Q-39) and model verdicts (CLS-11, CLS-12, AI-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..domains import CATEGORIES
from ..operators import ai as M
from ..operators import intake as I
from ..operators.exports import filter_summary
from . import fixtures as X
from .registry import ORACLES, query
from .source_queries import catalog_reconcile

_RAW = {
    "source_id": "source_id",
    "id": "id",
    "title": "CASE WHEN id % 11 = 0 THEN '  ' ELSE concat('  Item   ', CAST(id AS VARCHAR(20)), ' of   source ') END",
    "original_url": "CASE id % 13 WHEN 0 THEN 'mailto:a@b.example' WHEN 1 THEN concat(' HTTPS://Host.Example/n/', CAST(id % 40 AS VARCHAR(20)), '/?utm_source=x&b=2&a=1#top ') ELSE concat('https://host.example/n/', CAST(id % 40 AS VARCHAR(20))) END",
    "summary": "CASE WHEN id % 3 = 0 THEN '   ' WHEN id % 3 = 1 THEN concat('short   text ', lang) END",
    "published_at": "published_at",
    "extra": "CASE WHEN id % 17 = 0 THEN '[1]' WHEN id % 17 = 1 THEN '{\"a\":\"1\",\"_source_discoveries\":\"x\"}' WHEN id % 17 = 2 THEN '{' ELSE '{\"k\":\"v\"}' END",
}
_RAW_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _RAW.items()) + " FROM items"
_ITEM_SQL = f"""raw AS ({_RAW_SQL}), normal AS (SELECT source_id, id, published_at, CASE WHEN id % 11 = 0 THEN '' ELSE concat('Item ', CAST(id AS VARCHAR), ' of source') END AS title,
CASE id % 13 WHEN 0 THEN NULL WHEN 1 THEN concat('https://host.example/n/', CAST(id % 40 AS VARCHAR), '?a=1&b=2') ELSE original_url END AS canonical_url,
CASE WHEN id % 3 = 1 THEN concat('short text ', trim(substr(summary, 13))) END AS summary,
CASE WHEN id % 11 = 0 THEN 'item title is empty' WHEN id % 13 = 0 THEN 'item URL must be an absolute HTTP(S) URL' WHEN id % 17 IN (0, 2) THEN 'item extra must be a JSON object with string keys' END AS error,
CASE id % 17 WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 1 THEN '{{"a":"1"}}' ELSE '{{"k":"v"}}' END AS extra FROM raw)"""


def _normal(spark, d):
    return I.normalize_items(X.items(spark, d).selectExpr(*[f"{e.replace('VARCHAR(20)', 'STRING')} AS {n}" for n, e in _RAW.items()]))


@query("normalize_items", X.WITH + f", {_ITEM_SQL} SELECT id, title, canonical_url, summary, error, extra FROM normal")
def normalize_items(spark, d):
    return _normal(spark, d).select("id", "title", "canonical_url", "summary", "error", "extra")


_FAMILY = "SELECT id, source_id, sha256(concat('p', CAST(id AS VARCHAR(20)))) AS fingerprint, CASE WHEN id % 10 BETWEEN 1 AND 3 THEN sha256(concat('p', CAST(id - id % 10 AS VARCHAR(20)))) WHEN id % 10 = 4 THEN 'short' END AS parent_fingerprint, CASE WHEN id % 50 = 5 THEN CAST(1 AS BIGINT) END AS parent_item_id FROM items"


@query("parent_links", X.WITH + f", f AS ({_FAMILY}) SELECT c.id, coalesce(p.id, c.parent_item_id) AS parent_item_id FROM f c LEFT JOIN f p ON p.source_id = c.source_id AND p.fingerprint = c.parent_fingerprint")
def parent_links(spark, d):
    text = lambda c: F.sha2(F.concat(F.lit("p"), c.cast("string")), 256)
    k = F.col("id") % 10
    rows = X.items(spark, d).select("id", "source_id", text(F.col("id")).alias("fingerprint"), F.when(k.between(1, 3), text(F.col("id") - k)).when(k == 4, "short").alias("parent_fingerprint"), F.when(F.col("id") % 50 == 5, F.lit(1).cast("long")).alias("parent_item_id"))
    return I.with_parents(rows).select("id", "parent_item_id")


_NOTICE = "concat('主办机构：机构', CAST(id % 7 AS VARCHAR(20)), '。申报对象: all of ', lang, '；截止日期：2024年', CAST(id % 12 + 1 AS VARCHAR(20)), '月', CAST(id % 28 + 1 AS VARCHAR(20)), '日。')"
_EXTRA = "CASE WHEN id % 4 = 0 THEN '{\"organizer\":\"  Given  name \",\"application_method\":\"post\",\"application_url\":\"HTTPS://Apply.example/x/?utm_source=a&b=2#top\"}' ELSE '{}' END"


@query(
    "opportunity_fields",
    X.WITH
    + """, o AS (SELECT id, lang, title, primary_type = 'application_opportunity' AS ok FROM items) SELECT id, CASE WHEN ok THEN CASE WHEN id % 4 = 0 THEN 'Given name' ELSE concat('机构', CAST(id % 7 AS VARCHAR)) END END AS organizer,
    CASE WHEN ok THEN substr(title, 1, 500) END AS application_name, CASE WHEN ok THEN concat('all of ', lang) END AS application_target, CASE WHEN ok AND id % 4 = 0 THEN 'post' END AS application_method, CASE WHEN ok AND id % 4 = 0 THEN 'https://apply.example/x?b=2' END AS application_url,
    CASE WHEN ok THEN CAST(epoch(make_timestamp(2024, id % 12 + 1, CASE WHEN id % 28 < 9 THEN id % 28 + 1 ELSE (id % 28 + 1) // 10 END, 23, 59, 59.0)) AS BIGINT) - 28800 END AS deadline FROM o""",
)
def opportunity_fields(spark, d):
    rows = X.items(spark, d).withColumns({"notice": F.expr(_NOTICE.replace("VARCHAR(20)", "STRING")), "extra": F.expr(_EXTRA)})
    f = I.opportunity_fields(F.col("title"), F.col("notice"), F.col("extra"), F.col("primary_type"))
    rows = rows.select("id", f.alias("f"))
    return rows.select("id", "f.organizer", "f.application_name", "f.application_target", "f.application_method", "f.application_url", F.unix_timestamp("f.deadline_at").alias("deadline"))


_TAGS = {"model_technology": ["model"], "agent_product": ["agent"], "award_case": ["award"], "enterprise_case": ["case", "industry_application"], "policy_industry": ["policy"]}
_TYPES = [
    (["model_technology", "agent_product"], ["release", "the "], "product_update"),
    (["solicitation"], ["call", "les"], "application_opportunity"),
    (["award_case"], ["winner", "der"], "award_result"),
    (["policy_industry"], ["policy", "that"], "policy_standard"),
    (["policy_industry"], ["report", "with"], "report_release"),
]
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_has = lambda words: "(" + " OR ".join(f"title LIKE '%{w}%'" for w in words) + ")"
_KIND = "CASE " + " ".join(f"WHEN category IN {_in(c)} AND {_has(w)} THEN '{t}'" for c, w, t in _TYPES) + " ELSE 'unclassified' END"


@query(
    "taxonomy_backfill",
    X.WITH
    + f""", k AS (SELECT i.*, s.kind, {_KIND} AS derived FROM items i JOIN sources s ON s.id = i.source_id) SELECT id, derived AS primary_type,
    CASE category {' '.join(f"WHEN '{c}' THEN '{','.join(t)}'" for c, t in _TAGS.items())} ELSE '' END AS topics, CASE WHEN title LIKE '%on%' AND category IN ('enterprise_case', 'award_case') THEN 'case_lead' ELSE 'not_case' END AS case_completeness,
    CASE WHEN kind = 'formal' THEN 'official_confirmed' ELSE verification_status END AS verification_status, CASE WHEN kind = 'formal' THEN 'not_required' ELSE review_status END AS review_status,
    CASE WHEN manual_category IS NOT NULL AND derived <> 'unclassified' THEN derived ELSE manual_primary_type END AS manual_primary_type FROM k""",
)
def taxonomy_backfill(spark, d):
    kinds = X.sources(spark, d).select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"))
    out = I.backfill(X.items(spark, d).join(kinds, "source_id"), _TAGS, _TYPES, ["on"], ["enterprise_case", "award_case"])
    return out.select("id", "primary_type", F.array_join("topic_tags", ",").alias("topics"), "case_completeness", "verification_status", "review_status", "manual_primary_type")


_SEEN = f"{_ITEM_SQL}, seen AS (SELECT *, id AS pos, id % 5 <> 1 AS accepted, CASE WHEN id % 2 = 0 THEN 'quality.below_minimum' ELSE 'source.exclude_term' END AS reason, CASE WHEN source_id % 2 = 0 THEN 'host.example' ELSE 'other.example' END AS site_host FROM normal)"


def _seen(spark, d):
    return _normal(spark, d).withColumns({
        "pos": F.col("id"), "accepted": F.col("id") % 5 != 1, "reason": F.when(F.col("id") % 2 == 0, "quality.below_minimum").otherwise("source.exclude_term"),
        "site_host": F.when(F.col("source_id") % 2 == 0, "host.example").otherwise("other.example"),
    })


_TYPES_SEEN = {"verification_statuses": "verification_status", "review_statuses": "review_status", "primary_types": "primary_type"}
_FLAT = ("failures", "rejections", *_TYPES_SEEN)


@query(
    "preview_quality_stats",
    X.WITH
    + f""", {_SEEN}, typed AS (SELECT s.*, i.primary_type, i.verification_status, i.review_status FROM seen s JOIN items i ON i.id = s.id),
    counted AS (SELECT source_id, count(*) AS discovered, count(*) FILTER (WHERE error IS NULL AND accepted) AS accepted, count(*) FILTER (WHERE error IS NULL AND NOT accepted) AS rejected, count(error) AS failed,
    count(*) FILTER (WHERE error IS NULL) AS ok, count(published_at) FILTER (WHERE error IS NULL) AS dated, count(*) FILTER (WHERE error IS NULL AND site_host <> 'host.example') AS outside, count(DISTINCT CASE WHEN error IS NULL THEN canonical_url END) AS urls FROM seen GROUP BY source_id),
    long AS (SELECT source_id, 'failures' AS m, error AS k FROM typed UNION ALL SELECT source_id, 'rejections', reason FROM typed WHERE error IS NULL AND NOT accepted {" ".join(f"UNION ALL SELECT source_id, '{m}', {c} FROM typed WHERE error IS NULL" for m, c in _TYPES_SEEN.items())}),
    maps AS (SELECT source_id, m, string_agg(k || ':' || n, ',' ORDER BY k) AS v FROM (SELECT source_id, m, k, CAST(count(*) AS VARCHAR) AS n FROM long WHERE k IS NOT NULL GROUP BY ALL) GROUP BY source_id, m)
    SELECT source_id, CASE WHEN ok = 0 THEN 'failed' ELSE 'success' END AS status, discovered, ok AS normalized, accepted, rejected, failed, ok / greatest(ok, 1) AS title_ratio, dated / greatest(ok, 1) AS date_ratio, ok / greatest(ok, 1) AS link_ratio, outside / greatest(ok, 1) AS external_ratio,
    ok - urls AS duplicates, (ok - urls) / greatest(ok, 1) AS duplicate_ratio, {", ".join(f"(SELECT v FROM maps WHERE maps.source_id = counted.source_id AND m = '{m}') AS {m}" for m in _FLAT)} FROM counted""",
)
def preview_quality_stats(spark, d):
    types = X.items(spark, d).select("id", *I.HISTOGRAMS)
    out = I.preview_stats(_seen(spark, d).join(types, "id"))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.withColumns({m: flat(F.col(m)) for m in _FLAT})


@query(
    "onboarding_preview",
    X.WITH
    + f""", {_SEEN}, g AS (SELECT * REPLACE (CASE WHEN source_id % 3 <> 0 AND error IS NULL THEN concat('https://host.example/own/', CAST(id AS VARCHAR)) ELSE canonical_url END AS canonical_url), error IS NULL AND accepted AS fine FROM seen), h AS (SELECT *, fine AND row_number() OVER (PARTITION BY source_id, fine, canonical_url ORDER BY pos) = 1 AND row_number() OVER (PARTITION BY source_id, fine, lower(title) ORDER BY pos) = 1 AS good FROM g),
    p AS (SELECT *, sum(CAST(good AS INTEGER)) OVER (PARTITION BY source_id ORDER BY pos) - CAST(good AS INTEGER) < 10 AS read FROM h), b AS (SELECT source_id, count(*) FILTER (WHERE read AND NOT good) AS bad, count(*) AS n FROM p GROUP BY source_id)
    SELECT p.source_id, pos, title, canonical_url FROM p JOIN b ON b.source_id = p.source_id WHERE good AND read AND NOT (bad >= 3 AND bad * 3 >= n * 2)""",
)
def onboarding_preview(spark, d):
    # two sources of three give each item an address of its own and show some; the others repeat a few and show nothing
    own = F.concat(F.lit("https://host.example/own/"), F.col("id").cast("string"))
    return I.preview(_seen(spark, d).withColumn("canonical_url", F.when((F.col("source_id") % 3 != 0) & F.col("error").isNull(), own).otherwise(F.col("canonical_url"))))


@query(
    "source_outcomes",
    X.WITH
    + f""", {_SEEN}, o AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE error IS NULL AND source_id % 5 <> 2) AS valid FROM seen WHERE source_id % 4 <> 3 GROUP BY source_id),
    e AS (SELECT *, CASE WHEN source_id % 4 = 1 THEN 'fetch.failed' WHEN valid = 0 THEN 'all collected records failed normalization' END AS error FROM o)
    SELECT s.id, CASE WHEN e.source_id IS NOT NULL THEN 5 END AS checked, CASE WHEN e.source_id IS NOT NULL AND e.error IS NULL THEN 5 END AS success, CASE WHEN e.source_id IS NULL THEN s.last_error ELSE e.error END AS last_error FROM sources s LEFT JOIN e ON e.source_id = s.id""",
)
def source_outcomes(spark, d):
    rows = _seen(spark, d).filter("source_id % 4 <> 3").groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("error").isNull() & (F.col("source_id") % 5 != 2)).alias("valid"))
    rows = rows.withColumn("error", F.when(F.col("source_id") % 4 == 1, I.failure_reason(F.lit("collection"), F.lit("fetch"))))
    none = F.lit(None).cast("int")
    sources = X.sources(spark, d).select("id", none.alias("last_checked"), none.alias("last_success"), "last_error")
    return I.source_states(sources, rows, F.lit(5)).select("id", F.col("last_checked").alias("checked"), F.col("last_success").alias("success"), "last_error")


_ROUNDS = """SELECT source_id, 1 + run_id % 2 AS round, status = 'success' AS success, CASE source_id % 3 WHEN 0 THEN 'Timeout after 15 s' WHEN 1 THEN 'HTTP 403' ELSE 'reset' END AS error,
CASE WHEN source_id % 4 = 3 THEN 'parse_or_collection.failed' WHEN source_id % 4 = 2 THEN 'persistence.failed' ELSE 'fetch.failed' END AS why, fetched_count AS discovered, new_count AS accepted, new_count AS new, skipped_count AS duplicate FROM executions"""


@query(
    "live_round_report",
    X.WITH
    + f""", r AS (SELECT *, CASE WHEN success THEN NULL WHEN why = 'fetch.failed' THEN CASE source_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http' ELSE 'network' END WHEN why = 'persistence.failed' THEN 'other' ELSE 'parse' END AS k FROM ({_ROUNDS}))
    SELECT count(DISTINCT source_id) AS active_total, count(*) AS source_rounds, count(*) FILTER (WHERE success) AS successful_rounds, count(*) FILTER (WHERE NOT success) AS failed_rounds, """
    + ", ".join(f"count(*) FILTER (WHERE k = '{k}') AS failed_{k}" for k in ("timeout", "http", "network", "parse", "other"))
    + "".join(f", CAST(sum({c}) FILTER (WHERE round = {n}) AS BIGINT) AS {c}_{n}" for n, cs in ((1, ("discovered", "accepted", "new")), (2, ("discovered", "accepted", "new", "duplicate"))) for c in cs)
    + " FROM r",
)
def live_round_report(spark, d):
    s = F.col("source_id")
    rows = X.executions(spark, d).select(
        "source_id", (1 + F.col("run_id") % 2).alias("round"), (F.col("status") == "success").alias("success"), F.when(s % 3 == 0, "Timeout after 15 s").when(s % 3 == 1, "HTTP 403").otherwise("reset").alias("error"),
        F.array(F.when(s % 4 == 3, "parse_or_collection.failed").when(s % 4 == 2, "persistence.failed").otherwise("fetch.failed")).alias("reasons"),
        F.col("fetched_count").alias("discovered"), F.col("new_count").alias("accepted"), F.col("new_count").alias("new"), F.col("skipped_count").alias("duplicate"),
    )
    return I.round_report(rows)


@query("catalog_sync_counters", X.WITH + ", " + ORACLES["catalog_reconcile"].removeprefix(X.WITH).removeprefix(", ").replace(") SELECT coalesce", "), r AS (SELECT coalesce", 1) + ") SELECT decision, count(*) AS n FROM r GROUP BY decision")
def catalog_sync_counters(spark, d):
    return catalog_reconcile(spark, d).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("sanitized_settings", "SELECT n_nationkey AS provider, n_name AS model, '' AS api_key FROM nation")
def sanitized_settings(spark, d):
    return I.sanitized(X.table(spark, d, "nation").select(F.col("n_nationkey").alias("provider"), F.col("n_name").alias("model"), F.lit("secret").alias("api_key")))


@query("quantified_outcomes", X.WITH + f"SELECT id, regexp_matches(concat('grew ', CAST(id AS VARCHAR), CASE WHEN id % 3 = 0 THEN ' 倍' WHEN id % 3 = 1 THEN '%' ELSE ' x' END), '{I.QUANTIFIED}') AS quantified FROM items")
def quantified_outcomes(spark, d):
    unit = F.when(F.col("id") % 3 == 0, " 倍").when(F.col("id") % 3 == 1, "%").otherwise(" x")
    return X.items(spark, d).select("id", I.quantified(F.concat(F.lit("grew "), F.col("id").cast("string"), unit)).alias("quantified"))


@query("update_fields", X.WITH + "SELECT id, CASE WHEN id % 4 = 0 THEN concat('new ', title) ELSE title END AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE summary END AS summary FROM items WHERE source_id % 7 <> 3")
def update_fields(spark, d):
    items = X.items(spark, d).select("id", "source_id", "title", "summary")
    changes = items.filter("id % 4 = 0").select("id", F.concat(F.lit("new "), "title").alias("title"), F.lit(None).cast("string").alias("summary"))
    retired = X.sources(spark, d).filter("id % 7 = 3").select(F.col("id").alias("source_id"))
    return I.updated(items, changes, "id").join(retired, "source_id", "left_anti").select("id", "title", "summary")


_ANSWER = "CASE id % 8 WHEN 0 THEN 'no json' WHEN 1 THEN '{\"category\":\"nonsense\",\"confidence\":0.9}' WHEN 2 THEN concat('{\"category\":\"', category, '\"}') WHEN 3 THEN concat('{\"category\":\"', category, '\",\"confidence\":1.5}') ELSE concat('{\"category\":\"', category, '\",\"confidence\":', CAST((id % 10) / 10.0 AS VARCHAR(5)), ',\"reason\":\"because\"}') END"


@query(
    "model_verdicts",
    X.WITH
    + """SELECT id, CASE WHEN id % 8 > 3 THEN category ELSE 'unclassified' END AS category, CAST(CASE WHEN id % 8 > 3 THEN id % 10 ELSE 0 END AS BIGINT) AS score, id % 8 > 3 AND id % 10 < 6 AS is_ambiguous,
    CASE id % 8 WHEN 0 THEN 'invalid JSON' WHEN 1 THEN 'unknown category' WHEN 2 THEN 'confidence is no number' WHEN 3 THEN 'confidence out of range' END AS error FROM items""",
)
def model_verdicts(spark, d):
    answer = F.concat(F.lit('{"category":"'), "category", F.lit('","confidence":'), ((F.col("id") % 10) / 10.0).cast("string"), F.lit(',"reason":"because"}'))
    k = F.col("id") % 8
    text = F.when(k == 0, "no json").when(k == 1, '{"category":"nonsense","confidence":0.9}').when(k == 2, F.concat(F.lit('{"category":"'), "category", F.lit('"}'))).when(k == 3, F.concat(F.lit('{"category":"'), "category", F.lit('","confidence":1.5}'))).otherwise(answer)
    rows = X.items(spark, d).select("id", M.verdict(text, CATEGORIES).alias("v"))
    return rows.select("id", "v.category", F.round("v.score").cast("long").alias("score"), "v.is_ambiguous", "v.error")


@query(
    "smart_two_rounds",
    X.WITH
    + """, f AS (SELECT id, category AS c1, (id % 10) / 10.0 AS conf, summary IS NOT NULL AS has FROM items), r AS (SELECT *, has AND (conf < 0.75 OR c1 = 'unclassified') AS again FROM f)
    SELECT id, CASE WHEN again THEN 'policy_industry' ELSE c1 END AS category, CASE WHEN again THEN 2 ELSE 1 END AS round FROM r""",
)
def smart_two_rounds(spark, d):
    first = lambda df: df.select("id", "category", ((F.col("id") % 10) / 10.0).alias("confidence"))
    second = lambda df: df.select("id", F.lit("policy_industry").alias("category"), F.lit(0.9).alias("confidence"))
    return M.two_rounds(X.items(spark, d), first, second, lambda c: (F.col("confidence") < 0.75) | (F.col("category") == "unclassified")).select("id", "category", "round")


@query("recent_jobs", "SELECT o_orderkey AS id, o_orderstatus IN ('O', 'P') AS active FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def recent_jobs(spark, d):
    jobs = X.table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20)
    return jobs.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").isin("O", "P").alias("active"))


@query("point_lookups", X.WITH + "SELECT i.id, s.slug FROM items i JOIN sources s ON s.id = i.source_id WHERE s.slug = 'source-3' OR s.start_url = 'https://host2.example/src2'")
def point_lookups(spark, d):
    wanted = X.sources(spark, d).filter((F.col("slug") == "source-3") | (F.col("start_url") == "https://host2.example/src2")).select(F.col("id").alias("source_id"), "slug")
    return X.items(spark, d).join(wanted, "source_id").select("id", "slug")


@query(
    "export_filter_summary",
    X.WITH
    + """SELECT id, concat_ws('; ', CASE WHEN id % 3 = 0 THEN concat('关键词: ', lang) END, CASE WHEN id % 2 = 0 THEN concat('分类: ', category) END, concat('来源 ID: ', CAST(source_id AS VARCHAR)), '来源范围: all',
    CASE WHEN id % 5 = 0 THEN '仅收藏' WHEN id % 5 = 1 THEN '未收藏' END, '发布时间从 ' || strftime(published_at, '%Y-%m-%d'), '发现时间早于 ' || strftime(discovered_at, '%Y-%m-%d'), CASE WHEN id % 7 = 0 THEN '排除待分类' END) AS filters FROM items""",
)
def export_filter_summary(spark, d):
    none = F.lit(None).cast("timestamp")
    f = {
        "keyword": F.when(F.col("id") % 3 == 0, F.col("lang")), "category": F.when(F.col("id") % 2 == 0, F.col("category")), "source_id": F.col("source_id"), "scope": F.lit("all"),
        "favorite": F.when(F.col("id") % 5 == 0, True).when(F.col("id") % 5 == 1, False), "published_from": F.col("published_at"), "published_to": none, "discovered_from": none, "discovered_to": F.col("discovered_at"),
        "unclassified": F.when(F.col("id") % 7 == 0, False),
    }
    return X.items(spark, d).select("id", filter_summary(f).alias("filters"))


# the model answers nothing to some, an error to others, and at length to the rest
_SUMMED = "s AS (SELECT id, CASE WHEN summary IS NULL THEN 'skipped' WHEN id % 5 < 2 THEN 'failed' ELSE 'saved' END AS result, title, ai_summary FROM items WHERE is_active AND admission_accepted AND ai_summary IS NULL)"


def _summed(spark, d):
    answer = F.when(F.col("id") % 5 > 1, F.concat(F.lit("  about "), "id", F.lit(" "), F.repeat(F.lit("x"), F.when(F.col("id") % 3 == 0, 2000).otherwise(1))))
    model = lambda asked: asked.select("id", answer.alias("answer"), F.when(F.col("id") % 5 == 1, "<b>limit</b> at https://u:p@m.example/v1?key=1").alias("error"))
    return M.summarized(X.items(spark, d), model)


@query("summaries_by_model", X.WITH + f", {_SUMMED} SELECT id, result, CASE WHEN result = 'saved' THEN substr(concat('about ', CAST(id AS VARCHAR), ' ', repeat('x', CASE WHEN id % 3 = 0 THEN 2000 ELSE 1 END)), 1, 1000) END AS text, CASE WHEN result = 'failed' THEN CASE WHEN id % 5 = 1 THEN 'limit at https://m.example/v1' ELSE 'no answer' END END AS error FROM s")
def summaries_by_model(spark, d):
    return _summed(spark, d)


@query(
    "summary_job",
    X.WITH + f", {_SUMMED} SELECT count(*) AS processed, count(*) FILTER (WHERE result = 'saved') AS success, count(*) FILTER (WHERE result = 'failed') AS failure, count(*) FILTER (WHERE result = 'skipped') AS skipped, CASE WHEN count(*) FILTER (WHERE result = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE result <> 'failed') > 0 THEN 'partial_failure' ELSE 'failed' END AS status FROM s",
)
def summary_job(spark, d):
    return M.summary_job(_summed(spark, d))
