"""Places in an order, chapters, cells and notes of exports, with expected rows written by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import exports as E

ITEM = "id long, title string, summary string, primary_type string, manual_primary_type string, published_at timestamp, discovered_at timestamp"
NOW = datetime(2024, 1, 1)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_ranked_over_any_partitions(spark, parts):
    rows = spark.range(997).select(((F.col("id") * 389) % 997).alias("v"), F.lit("a").alias("hot")).repartition(parts)
    got = E.ranked(rows, [F.col("hot"), F.col("v").desc()], "place").collect()
    assert sorted((r.place, r.v) for r in got) == [(i + 1, 996 - i) for i in range(997)]
    assert set(got[0].asDict()) == {"v", "hot", "place"}


def test_ranked_of_nothing_repeats_and_nulls(spark):
    assert E.ranked(spark.range(0), [F.col("id")], "place").collect() == []
    rows = spark.createDataFrame([(2,), (None,), (2,), (1,), (2,)], "v int")
    assert sorted((r.place, r.v) for r in E.ranked(rows, [F.col("v").asc_nulls_first()], "place").collect()) == [(1, None), (2, 1), (3, 2), (4, 2), (5, 2)]


def test_chapters_follow_the_labels(spark):
    types = ["unclassified", "award_result", "product_update", "award_result", None, "product_update"]
    rows = spark.createDataFrame([(i, "t", None, t, "case_analysis" if i == 5 else None, None, NOW) for i, t in enumerate(types)], ITEM)
    got = {r.id: (r.chapter, r.number) for r in E.chapters(rows).collect()}
    # newest ids first; the item without a type is unclassified, the last chapter
    assert got == {2: (1, 1), 3: (2, 1), 1: (2, 2), 5: (3, 1), 4: (4, 1), 0: (4, 2)}


def test_cells(spark):
    given = ["=a", " +b", "-5", "-.5e+3%", "-x", "​@c", "a\x07b", "", None, "x" * 40_000, "=" + "x" * 40_000]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    got = [r.c for r in rows.select("i", T.formula_safe(F.col("g")).alias("c")).orderBy("i").collect()]
    assert got == ["'=a", "' +b", "-5", "-.5e+3%", "'-x", "'​@c", "ab", "", None, "x" * 32_766 + "…", "'=" + "x" * 32_764 + "…"]
    assert all(len(g or "") <= 32_767 for g in got)


def _full(spark):
    rows = [(1, "=t", None, "policy_standard", None, None, datetime(2024, 1, 2, 3, 4)), (2, None, "s", "odd", "award_result", datetime(2024, 5, 6, 7, 8), NOW)]
    df = spark.createDataFrame(rows, ITEM).withColumns({
        "category": F.lit("policy_industry"), "manual_category": F.when(F.col("id") == 2, "award_case"), "s_name": F.lit("@src"), "s_kind": F.lit("formal"), "s_role": F.lit("fallback"), "favorite": F.col("id") == 1,
        "classification_score": F.lit(1.5), "classification_reason": F.lit(None).cast("string"), "topic_tags": F.when(F.col("id") == 1, F.array(F.lit("model"), F.lit("api"))), "industry_tags": F.array().cast("array<string>"),
        "verification_status": F.lit("media_only"), "review_status": F.lit("pending"), "original_url": F.when(F.col("id") == 1, "https://a.example/x").otherwise("mailto:a"), "discovery_url": F.lit(None).cast("string"), "official_url": F.lit("https://o.example/"),
    })
    return df


def test_table_of_cells(spark):
    first, second = E.table_rows(_full(spark)).orderBy("number").collect()
    assert list(second.asDict())[1:22] == list(E.TABLE_HEADS)
    assert first.asDict() == {
        "id": 2, "number": 1, "title": "", "category": "奖项与优秀案例", "category_origin": "人工", "source_name": "'@src", "published": "2024-05-06 07:08", "discovered": "2024-01-01 00:00", "summary": "s", "original": "链接不可用",
        "favorite": "否", "score": 1.5, "reason": "", "source_kind": "formal", "type": "奖项与入选结果", "topics": "", "industries": "", "source_role": "fallback", "verification": "media_only", "review": "pending",
        "discovery": "—", "official": "查看官方原文", "original_link": None, "discovery_link": None, "official_link": "https://o.example/",
    }
    assert (second.number, second.title, second.published, second.topics, second.original, second.original_link, second.type) == (2, "'=t", "", "model, api", "查看原文", "https://a.example/x", "政策与标准")


def test_written_table_and_notes(spark, tmp_path):
    table = E.table_rows(_full(spark))
    E.write_table(table, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == list(E.TABLE_HEADS.values()) and sorted(r["序号"] for r in back.collect()) == ["1", "2"]
    notes = E.table_notes(table, F.lit(NOW), F.lit("-1")).orderBy("turn").collect()
    assert [(r.item, r.content) for r in notes][:3] == [("生成时间", "2024-01-01 00:00"), ("筛选条件", "-1"), ("导出条数", "2")]


def test_bounded_rows_never_cut(spark):
    rows = spark.createDataFrame([(i, "t", None, "award_result", None, None, NOW) for i in range(3)], ITEM)
    assert [r.id for r in E.bounded_rows(rows, 3).collect()] == [2, 1, 0]
    for most, of in ((2, rows), (3, rows.limit(0))):
        with pytest.raises(ValueError):
            E.bounded_rows(of, most)
