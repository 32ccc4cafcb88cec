"""Queries of exports: the table of 21 columns with global numbers, and its notes (SINK-2)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import exports as E
from ..operators.items import with_source
from . import fixtures as X
from .registry import query
from .scalar_queries import safe_cell_sql

# what the items lack: scores, reasons that begin like formulas, tags, and addresses of which some are no safe links
_MORE = {
    "classification_score": "CASE WHEN id % 8 <> 0 THEN (id % 40) / 4.0 END",
    "classification_reason": "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('=cmd ', lang) WHEN 2 THEN '-1.5e3%' WHEN 3 THEN '  -.' ELSE lang END",
    "original_url": "CASE id % 7 WHEN 0 THEN 'javascript:alert(1)' WHEN 1 THEN concat('https://a.example/', repeat('x', 2100)) WHEN 2 THEN NULL ELSE concat('https://a.example/', CAST(id AS VARCHAR(20))) END",
    "discovery_url": "CASE WHEN id % 3 = 0 THEN concat('http://d.example/', CAST(id AS VARCHAR(20))) END",
    "official_url": "CASE WHEN id % 4 = 0 THEN concat('ftp://o.example/', CAST(id AS VARCHAR(20))) WHEN id % 4 = 1 THEN concat('https://o.example/', CAST(id AS VARCHAR(20))) END",
    "tags": "CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'model' ELSE 'model, award' END",
}
_SPARK = {n: e.replace("VARCHAR(20)", "STRING") for n, e in _MORE.items()}


def _labels(labels: dict[str, str], value: str) -> str:
    return f"CASE {value} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in labels.items())} END"


def _link(c: str) -> str:
    return f"CASE WHEN starts_with({c}, 'http') AND length({c}) <= 2048 THEN {c} END"


def _shown(c: str, yes: str, no: str) -> str:
    return f"CASE WHEN {_link(c)} IS NULL THEN '{no}' ELSE '{yes}' END"


_CELLS = {
    "id": "id", "number": f"row_number() OVER (ORDER BY {X.RECENT})", "title": safe_cell_sql("title"), "category": _labels(E.CATEGORY_LABELS, "coalesce(manual_category, category)"),
    "category_origin": "CASE WHEN manual_category IS NULL THEN '自动' ELSE '人工' END", "source_name": "name", "published": "coalesce(strftime(published_at, '%Y-%m-%d %H:%M'), '')", "discovered": "strftime(discovered_at, '%Y-%m-%d %H:%M')",
    "summary": safe_cell_sql("coalesce(summary, '')"), "original": _shown("original_url", "查看原文", "链接不可用"), "favorite": "CASE WHEN favorite THEN '是' ELSE '否' END", "score": "CAST(classification_score AS DOUBLE)",
    "reason": "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('''=cmd ', lang) WHEN 2 THEN '-1.5e3%' WHEN 3 THEN '''  -.' ELSE lang END", "source_kind": "kind", "type": _labels(E.TYPE_LABELS, "coalesce(manual_primary_type, primary_type)"),
    "topics": "tags", "industries": "tags", "source_role": "role", "verification": "verification_status", "review": "review_status", "discovery": _shown("discovery_url", "查看发现页", "—"), "official": _shown("official_url", "查看官方原文", "—"),
    **{f"{n}_link": _link(f"{n}_url") for n in ("original", "discovery", "official")},
}
_ROWS = f"m AS (SELECT i.*, {', '.join(f'{e} AS {n}' for n, e in _MORE.items())} FROM items i WHERE is_active), t AS (SELECT m.*, s.name, s.kind, s.role FROM m JOIN sources s ON s.id = m.source_id)"


def _items(spark, d):
    rows = X.items(spark, d).filter("is_active").selectExpr("*", *[f"{e} AS {n}" for n, e in _SPARK.items()])
    tags = F.when(F.col("tags") == "", F.array().cast("array<string>")).otherwise(F.split("tags", ", "))
    rows = rows.withColumns({"topic_tags": tags, "industry_tags": tags, "classification_score": F.col("classification_score").cast("double")})
    return with_source(rows, X.sources(spark, d))


@query("export_table", X.WITH + f", {_ROWS} SELECT {', '.join(f'{e} AS {n}' for n, e in _CELLS.items())} FROM t")
def export_table(spark, d):
    return E.table_rows(_items(spark, d))


@query(
    "export_table_notes",
    X.WITH + f""", {_ROWS} SELECT * FROM (SELECT unnest([1, 2, 3, 4, 5]) AS turn, unnest(['生成时间', '筛选条件', '导出条数', '分类说明', '使用提示']) AS item,
    unnest(['2024-03-04 05:06', '''=来源范围: all', CAST(count(*) AS VARCHAR), '最终分类优先采用人工分类; 没有人工分类时使用自动分类。', '数据仅供内部参考, 请通过原文链接核对详情。']) AS content FROM t)""",
)
def export_table_notes(spark, d):
    return E.table_notes(_items(spark, d), F.lit(datetime(2024, 3, 4, 5, 6)), F.lit("=来源范围: all"))
