"""One-pass term and pattern matching against term-by-term scans, and the full roll-up of runs."""

import random

from pyspark.sql import functions as F

from quillstream.functions import text as T
from quillstream.operators import admission as A
from quillstream.operators import rules as R
from quillstream.operators import runs as N
from quillstream.operators import taxonomy as X
from quillstream.operators.terms import pattern_hits, term_hits


def texts(n=200):
    r = random.Random(5)
    words = ["the", "of the", "and the", "onthe", "in the", "inin", "ther", "there", "thing", "STUPID", "que los", "ción", "mente", "und der", "keit", "ß", "①", "，", "a.b", "c++", "x", " ", "los ", "trash", None]
    return [None, "", *("".join(r.choice([str(r.choice(words)), " ", r.choice("ab-."), "é"]) for _ in range(r.randint(1, 40))) for _ in range(n))]


def test_hits_are_what_scans_find(spark):
    terms = ["the", "of the", "a.b", "c++", "ción", "x", "thing", "，", "und der", "th"]
    df = spark.createDataFrame([(t,) for t in texts()], "t string").repartition(3)
    df, hits = term_hits(df, "h", terms, F.col("t"))
    plain = T.normalize_text(F.col("t"))
    for term in terms:
        assert df.filter(hits.has(term) != T.contains_term(plain, term)).count() == 0, term
    assert df.filter(hits.any(["x", "th"]) != (hits.has("x") | hits.has("th"))).count() == 0
    none, empty = term_hits(df, "g", [], F.col("t"))
    assert none.filter(empty.any([])).count() == 0


def test_scores_are_the_same_either_way(spark):
    r = random.Random(1)
    rows = texts()
    df = spark.createDataFrame([(i, t, r.choice(rows)) for i, t in enumerate(rows)], "i int, t string, s string")
    scanned = df.withColumns({"nt": T.normalize_text(F.col("t")), "ns": T.normalize_text(F.col("s"))})
    with_, title, summary = R.with_hits(df, F.col("t"), F.col("s"))
    for rule in R.PACK:
        want = scanned.select("i", R.category_score(rule, F.col("nt"), F.col("ns")), R.explanations(rule, F.col("nt"), F.col("ns"))).collect()
        assert sorted(want) == sorted(with_.select("i", R.category_score(rule, title, summary), R.explanations(rule, title, summary)).collect())
    with_, content = X.with_hits(df, F.col("t"), F.col("s"))
    of = lambda d, text: sorted(map(str, d.select("i", X.classify(X.hits(F.lit("official_product"), text), text).alias("c"), X.case_state(F.lit("case_analysis"), text, F.col("i") % 2 == 0).alias("s")).collect()))
    assert of(with_, content) == of(scanned.withColumn("c", X.content(F.col("nt"), F.col("ns"))), F.col("c"))


def test_every_pattern_has_words_that_its_matches_hold(spark):
    """A match of each alternative holds one of the pattern's words: else a text would never be tried."""
    samples = {
        "content.recruitment": ["We are HIRING now", "join our team", "a vacancy", "vacancies", "招聘"], "content.course": ["training course", "Webinar replay", "培训班"], "content.advert": ["Limited offer", "buy now", "discount", "优惠"],
        "content.greeting": ["Happy New Year", "节日快乐"], "content.personnel": ["appointed as", "任命"], "content.visit": ["visited the", "调研"], "content.stock": ["share price", "股价"], "content.empty_cooperation": ["strategic cooperation", "战略合作"],
        "meeting": ["Meeting", "forum", "conference", "会议"], "substance": ["released", "launch", "published", "awarded", "发布"], "relevance": ["AI", "model", "agent", "the"],
        "prerelease": ["x-alpha.1", "v1 beta", ".rc1", "-nightly", "pre-release", "prerelease"], "maintenance": ["bugfix", "Bug  Fix", "fixes", "fixed", "fix", "patch", "dependency", "Dependencies", "依赖升级", "构建修复", "CI/CD", "文档修正", "changelog", "维护版本"],
        "official_product": ["参展", "融资"], "official_policy": ["座谈会"], "official_industry saving": ["Agent", "数据与AI", "AI的应用", "ai治理", "算力"], "opportunity_and_award_hub": ["通知"], "opportunity_and_award_hub saving": ["申报", "标准"],
    }
    rows = [(k, s) for k, ss in samples.items() for s in ss] + [(None, "nothing of it"), (None, None)]
    df, on = pattern_hits(spark.createDataFrame(rows, "k string, t string").repartition(3), "h", A.patterns(), F.col("t"))
    held = df.select("k", "t", F.transform("h", lambda i: F.array(*[F.lit(n) for n in on.terms])[i]).alias("names")).collect()
    assert all(r.k in r.names for r in held if r.k) and all(not r.names for r in held if not r.k)


def test_patterns_equal_scans_inside_the_jvm(spark):
    r = random.Random(3)
    parts = ["we are hiring", "discount", "the", "model", "AI", "fix", "fixes", "v1.0-rc1", "beta", "release", "released", "forum", "数据", "通知", "vacancy", "vacancies", "x", "招聘", "-", "_", " ", ".", "é"]
    df = spark.createDataFrame([("".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 12))),) for _ in range(400)], "t string")
    df, on = pattern_hits(df, "h", A.patterns(), F.col("t"))
    for k, (pattern, _) in A.patterns().items():
        assert df.filter(on.has(k) != F.col("t").rlike(pattern)).count() == 0, k


def test_finished_runs(spark):
    kinds = ", ".join(f"{c} long" for c in N.SUMS)
    row = lambda run, source, status, error, a, b, n: (run, source, f"s{source}", status, error, a, b, *([n] * len(N.SUMS)))
    rows = [
        row(1, 1, "success", None, {"x": 2}, {}, 3), row(1, 2, "failed", "<b>bad</b> token=secret", {"x": 1, "y": 4}, {"net": 1}, 4), row(2, 1, "failed", "e" * 1500, None, None, 1), row(2, 2, "failed", "f" * 1500, None, {"net": 2}, 1), row(2, 3, "failed", "never shown", None, None, 1),
    ]
    results = spark.createDataFrame(rows, f"run_id long, source_id long, source_name string, status string, error string, rejection_reasons map<string,bigint>, failure_reasons map<string,bigint>, {kinds}")
    runs = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "all broken")], "id long, fatal_error string")
    got = {r.run_id: r for r in N.finished(results, runs).collect()}
    assert (got[1].status, got[1].source_success, got[1].source_failed, got[1].new_count, got[1].duplicate_count) == ("partial_success", 1, 1, 7, 7)
    assert got[1].rejection_reasons == {"x": 3, "y": 4} and got[1].failure_reasons == {"net": 1} and got[1].error_summary == "s2: bad token=***"
    assert got[2].status == "failed" and len(got[2].error_summary) == 2000 and got[2].error_summary.startswith("s1: eee") and "; s2: fff" in got[2].error_summary
    assert (got[3].status, got[3].new_count, got[3].rejection_reasons, got[3].error_summary) == ("success", 0, {}, None)
    assert (got[4].status, got[4].error_summary) == ("failed", "pipeline: all broken")
