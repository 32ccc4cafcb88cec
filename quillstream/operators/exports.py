"""Exports: places in an order, projections, chapters, bounds that fail rather than cut, and safe cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import formula_safe, safe_link
from .items import effective, recency
from .upsert import checkpointed

TABLE_ROWS, DOCUMENT_ROWS = 10_000, 2_000
# Labels in the order of chapters, and the heads of a table's columns.
CATEGORY_LABELS = {
    "model_technology": "大模型与技术", "agent_product": "智能体与产品", "enterprise_case": "企业成果与案例", "award_case": "奖项与优秀案例", "solicitation": "征集与申报",
    "policy_industry": "政策、标准与行业", "irrelevant": "非目标情报", "unclassified": "待分类",
}
TYPE_LABELS = {
    "product_update": "产品与模型更新", "policy_standard": "政策与标准", "application_opportunity": "申报与征集机会", "award_result": "奖项与入选结果", "report_release": "报告发布",
    "case_analysis": "案例分析", "industry_signal": "行业线索", "unclassified": "待确认",
}
TABLE_HEADS = {
    "number": "序号", "title": "标题", "category": "最终分类", "category_origin": "分类来源", "source_name": "来源名称", "published": "发布时间", "discovered": "发现时间", "summary": "简介", "original": "原文链接",
    "favorite": "收藏状态", "score": "自动分类分数", "reason": "自动分类原因", "source_kind": "来源性质", "type": "主要信息形态", "topics": "主题标签", "industries": "行业标签", "source_role": "来源角色",
    "verification": "可信状态", "review": "审核状态", "discovery": "发现链接", "official": "官方原文",
}


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place, from 1 on, in an order over all of them.

    The rows are parted into ranges and each range is sorted by itself; a row's place is its place in its range and
    the rows of the ranges before, of which there are as many counts as partitions.  Ties stand in any order, but the
    places are written once and stay."""
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg((F.max("_place") + 1).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_at", "_range", "_place", "_before")


def chapters(items: DataFrame) -> DataFrame:
    """Items with number within their effective type and the chapter of that type, in the order of TYPE_LABELS.

    Empty types get no chapter; an item without a type is unclassified, one of a type without a label comes first."""
    rows = items.withColumn("type", F.coalesce(effective("manual_primary_type", "primary_type"), F.lit("unclassified")))
    rows = rows.withColumn("_turn", F.array_position(F.array(*[F.lit(t) for t in TYPE_LABELS]), F.col("type")))
    placed = ranked(rows, [F.col("_turn").asc(), F.col("type").asc(), *recency()], "_rank")
    types = placed.groupBy("_turn", "type").agg(F.min("_rank").alias("_first"))
    types = types.select("type", "_first", F.row_number().over(Window.orderBy("_first")).alias("chapter"))
    return placed.join(types, "type").withColumn("number", (F.col("_rank") - F.col("_first") + 1).cast("int")).drop("_turn", "_rank", "_first")


def table_rows(items: DataFrame) -> DataFrame:
    """The cells of TABLE_HEADS, numbered by recency, and the three addresses behind original, discovery and official.

    items: the items with their source's attributes (items.with_source) and classification_score, classification_reason,
    original_url, discovery_url, official_url and the lists topic_tags and industry_tags.  Texts are safe cells; an
    address that is no safe link is null and its cell says so."""
    label = lambda labels, value: F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), value)
    when = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))
    cell = lambda c: formula_safe(F.coalesce(F.col(c), F.lit("")))
    tags = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    links = {c: safe_link(F.col(f"{c}_url")) for c in ("original", "discovery", "official")}
    shown = lambda c, yes, no: F.when(links[c].isNotNull(), yes).otherwise(no)
    cells = {
        "title": cell("title"), "category": label(CATEGORY_LABELS, effective("manual_category", "category")), "category_origin": F.when(F.col("manual_category").isNotNull(), "人工").otherwise("自动"), "source_name": cell("s_name"),
        "published": when("published_at"), "discovered": when("discovered_at"), "summary": cell("summary"), "original": shown("original", "查看原文", "链接不可用"), "favorite": F.when(F.col("favorite"), "是").otherwise("否"),
        "score": F.col("classification_score"), "reason": cell("classification_reason"), "source_kind": F.col("s_kind"), "type": label(TYPE_LABELS, effective("manual_primary_type", "primary_type")),
        "topics": tags("topic_tags"), "industries": tags("industry_tags"), "source_role": F.col("s_role"), "verification": F.col("verification_status"), "review": F.col("review_status"),
        "discovery": shown("discovery", "查看发现页", "—"), "official": shown("official", "查看官方原文", "—"),
    }
    out = ranked(items, recency(), "number").select("id", "number", *[c.alias(n) for n, c in cells.items()], *[c.alias(f"{n}_link") for n, c in links.items()])
    return out.select("id", *TABLE_HEADS, *[f"{n}_link" for n in links])


def write_table(table: DataFrame, path: str) -> None:
    """A table of table_rows as CSV files under the heads of its columns; file by file in the order of the numbers."""
    spread = table.repartitionByRange("number").sortWithinPartitions("number")
    spread.select(*[F.col(c).alias(h) for c, h in TABLE_HEADS.items()]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def table_notes(table: DataFrame, generated_at: Column, filters: Column) -> DataFrame:
    """The second sheet of a table: turn, item, content."""
    # fixed values: the lines of the sheet
    fixed = [("分类说明", F.lit("最终分类优先采用人工分类; 没有人工分类时使用自动分类。")), ("使用提示", F.lit("数据仅供内部参考, 请通过原文链接核对详情。"))]
    lines = [("生成时间", F.date_format(generated_at, "yyyy-MM-dd HH:mm")), ("筛选条件", formula_safe(filters)), ("导出条数", F.col("n").cast("string")), *fixed]
    rows = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(k).alias("item"), v.alias("content")) for i, (k, v) in enumerate(lines, 1)])
    return table.agg(F.count(F.lit(1)).alias("n")).select(F.explode(rows).alias("x")).select("x.*")


def cells(rows: DataFrame, text: list[str], links: list[str] = ()) -> DataFrame:
    return rows.withColumns({c: formula_safe(F.col(c)) for c in text} | {c: safe_link(F.col(c)) for c in links})


def bounded_rows(rows: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, newest first; more, or none, is an error, never a cut."""
    got = rows.orderBy(*recency()).limit(most + 1)
    n = got.count()
    if n == 0:
        raise ValueError("nothing to export")
    if n > most:
        raise ValueError(f"more than {most} rows")
    return got


def filter_summary(f: dict[str, Column]) -> Column:
    """The active filters of an export as one line; a null filter is off.

    f: keyword, category (its label), source_id, scope (always set), favorite, published_from, published_to, discovered_from,
    discovered_to, unclassified."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    # fixed values: the words of the summary
    parts = [
        F.concat(F.lit("关键词: "), F.nullif(f["keyword"], F.lit(""))), F.concat(F.lit("分类: "), f["category"]), F.concat(F.lit("来源 ID: "), f["source_id"].cast("string")), F.concat(F.lit("来源范围: "), f["scope"]),
        F.when(f["favorite"], "仅收藏").when(~f["favorite"], "未收藏"),
        *[F.concat(F.lit(f"{label}{way} "), day(f[f"{k}_{end}"])) for k, label in (("published", "发布时间"), ("discovered", "发现时间")) for end, way in (("from", "从"), ("to", "早于"))],
        F.when(f["unclassified"], "仅待分类").when(~f["unclassified"], "排除待分类"),
    ]
    return F.concat_ws("; ", *parts)
