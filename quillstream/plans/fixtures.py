"""The engine's tables as deterministic projections of the test tables, for Spark and for the second engine.

Both sides derive from one list of portable expressions; the few that differ stand in pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domains as D


def pick(values: list[str], index: str) -> str:
    """CASE over index % len(values): one of the values."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {whens} END"


_COMMON = {
    "id": "doc_id",
    "source_id": "CAST(substr(source, 4) AS BIGINT)",
    "lang": "lang",
    "is_read": "doc_id % 3 = 0",
    "favorite": "doc_id % 11 = 0",
    "category": pick(D.CATEGORIES, "doc_id"),
    "manual_category": "CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 0 THEN 'policy_industry' END",
    "primary_type": pick(D.PRIMARY_TYPES, "CAST(floor(doc_id / 3) AS BIGINT)"),
    "manual_primary_type": "CASE WHEN doc_id % 13 = 0 THEN 'report_release' END",
    "verification_status": pick(D.VERIFICATION, "doc_id"),
    "review_status": pick(D.REVIEW, "CAST(floor(doc_id / 5) AS BIGINT)"),
    "taxonomy_version": "CASE WHEN doc_id % 9 = 0 THEN 'v1' ELSE 'v2' END",
    "admission_accepted": "doc_id % 10 <> 0",
    "is_active": "doc_id % 17 <> 0",
    "ai_summary": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'summary' END",
}
#: The first line is an item's title, all that follows it the summary.
_TEXTS = {
    "spark": {"title": "substring_index(text, '\n', 1)", "summary": "nullif(substr(text, length(substring_index(text, '\n', 1)) + 2), '')"},
    "duck": {"title": "split_part(text, chr(10), 1)", "summary": "nullif(substr(text, length(split_part(text, chr(10), 1)) + 2), '')"},
}
_TIMES = {
    "spark": {
        "published_at": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE timestamp_seconds(1704067200 + doc_id * 3600) END",
        "discovered_at": "timestamp_seconds(1706745600 + doc_id * 60)",
    },
    "duck": {
        "published_at": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE make_timestamp((1704067200 + doc_id * 3600) * 1000000) END",
        "discovered_at": "make_timestamp((1706745600 + doc_id * 60) * 1000000)",
    },
}
_SOURCE = {
    "id": "sid",
    "name": "name",
    "slug": "concat('source-', CAST(sid AS VARCHAR(20)))",
    "start_url": "concat('https://host', CAST(sid % 7 AS VARCHAR(20)), '.example/', name)",
    "enabled": "sid % 6 <> 5",
    "lifecycle": pick(D.LIFECYCLES, "sid + 1"),
    "managed": "sid % 2 = 0",
    "kind": pick(D.KINDS, "sid"),
    "origin": pick(D.ORIGINS, "CAST(floor(sid / 2) AS BIGINT)"),
    "tier": pick(D.TIERS, "sid"),
    "role": pick(D.ROLES, "sid"),
    "audience": pick(D.AUDIENCES, "sid"),
    "policy": pick(D.POLICIES, "sid"),
    "implementation": pick(D.IMPLEMENTATION, "CAST(floor(sid / 3) AS BIGINT)"),
    "homepage_visible": "sid % 4 <> 3",
    "export_visible": "sid % 5 <> 4",
    "last_error": "CASE WHEN sid % 7 = 0 THEN 'timeout' END",
    # comma-separated, empty: all types
    "allowed_types": "CASE WHEN sid % 3 = 0 THEN '' WHEN sid % 3 = 1 THEN 'product_update,award_result,case_analysis' ELSE 'policy_standard,report_release' END",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


ITEMS_SQL = f"""SELECT {_select(_COMMON)}, {_select(_TEXTS["duck"])}, {_select(_TIMES["duck"])}
FROM (SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)"""
SOURCES_SQL = f"SELECT {_select(_SOURCE)} FROM (SELECT DISTINCT source AS name, CAST(substr(source, 4) AS BIGINT) AS sid FROM documents)"
RUNS_SQL = f"""SELECT o_orderkey AS id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'partial_success' ELSE 'failed' END AS status,
{pick(D.TRIGGERS, "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)")} AS trigger_kind, o_custkey AS actor FROM orders"""
EXECUTIONS_SQL = """SELECT l_orderkey AS run_id, l_suppkey AS source_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS new_count, count(*) AS fetched_count,
CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS skipped_count, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'success' END AS status,
min(l_returnflag) AS reason FROM lineitem GROUP BY l_orderkey, l_suppkey"""
WITH = f"WITH items AS ({ITEMS_SQL}), sources AS ({SOURCES_SQL}), runs AS ({RUNS_SQL}), executions AS ({EXECUTIONS_SQL}) "
#: Rows of a table with their place in it, their address, and their source and fingerprint as one text.
NUMBERED = "SELECT row_number() OVER (ORDER BY {seq}) AS k, {seq} AS seq, canonical_url AS url, CAST(source_id AS VARCHAR) || ':' || fingerprint AS mark FROM {t}"
#: The second engine's form of the order that lists have.
RECENT = "coalesce(published_at, discovered_at) DESC, id DESC"


def fold(name: str, rows: str) -> str:
    """Recursive CTE: of rows(k from 1, seq, url, mark) the row each merges into, the first ones with their keys."""
    return f"""{name}(k, seq, urls, marks, ins, into_) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) UNION ALL
    SELECT k, seq, CASE WHEN t IS NULL THEN list_append(urls, url) ELSE urls END, CASE WHEN t IS NULL THEN list_append(marks, mark) ELSE marks END, CASE WHEN t IS NULL THEN list_append(ins, seq) ELSE ins END, coalesce(t, seq)
    FROM (SELECT r.k, r.seq, f.urls, f.marks, f.ins, r.url, r.mark, coalesce(f.ins[list_position(f.urls, r.url)], f.ins[list_position(f.marks, r.mark)]) AS t FROM {name} f JOIN {rows} r ON r.k = f.k + 1))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, whole, as items."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    columns = _COMMON | _TEXTS["spark"] | _TIMES["spark"]
    return rows.selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("source AS name", "CAST(substr(source, 4) AS BIGINT) AS sid").distinct()
    return rows.selectExpr(*[f"{e.replace('VARCHAR(20)', 'STRING')} AS {n}" for n, e in _SOURCE.items()])


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial_success").otherwise("failed").alias("status"),
        F.expr(pick(D.TRIGGERS, "CAST(substr(o_orderpriority, 1, 1) AS BIGINT)")).alias("trigger_kind"),
        F.col("o_custkey").alias("actor"),
    )


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each run and source: lineitem has several for some, so it is aggregated first."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("source_id"))
        .agg(
            F.sum(F.col("l_quantity").cast("long")).alias("new_count"),
            F.count(F.lit(1)).alias("fetched_count"),
            F.count_if(F.col("l_linestatus") == "O").alias("skipped_count"),
            F.when(F.max((F.col("l_returnflag") == "R").cast("int")) == 1, "failed").otherwise("success").alias("status"),
            F.min("l_returnflag").alias("reason"),
        )
    )
