"""Releases with their fallback, summaries by a model, fingerprints and run states, with expected rows written by hand."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstream.functions import times as D
from quillstream.operators import ai as M
from quillstream.operators import catalog as C
from quillstream.operators import rules as R
from quillstream.sources import payloads as P

API = "source_id long, rate_limited boolean, body string"
ATOM = "source_id long, base_url string, body string"


def _release(n, **more):
    return {"name": f"Release {n}", "tag_name": f"v{n}", "html_url": f"https://c.example/r/{n}", "published_at": "2024-01-02T03:04:05Z"} | more


def test_release_fallback(spark):
    body = json.dumps([_release(1), _release(2, prerelease=True), _release(3, draft=True), 7, _release(4, name=" ")])
    entry = "<entry><title>{}</title><link href='/r/{}'/></entry>"
    feed = "<feed>" + "".join(entry.format(t, i) for i, t in enumerate(["v9", "v9-rc.1", "v8 beta", "preview", "v7rc1", "v7.RC1", "precise"])) + "</feed>"
    api = spark.createDataFrame([(1, False, body), (2, True, body), (3, None, body[:20]), (4, True, None)], API)
    atoms = spark.createDataFrame([(1, "https://c.example/a", feed), (2, "https://c.example/a", feed), (3, "https://c.example/a", feed)], ATOM)
    got = sorted((r.source_id, r.title, r.tag, r.prerelease, r.fallback) for r in P.release_items(api, atoms).collect())
    atom = "atom_rate_limit"
    assert got == sorted([(1, "Release 1", "v1", False, None), (1, "v4", "v4", False, None), (2, "v9", "v9", False, atom), (2, "v7rc1", "v7rc1", False, atom), (2, "precise", "precise", False, atom)], key=lambda r: r[:2])
    more = P.release_items(api, atoms, prereleases=True, most=2).collect()
    assert sorted((r.source_id, r.title, r.prerelease) for r in more) == [(1, "Release 1", False), (1, "Release 2", True), (2, "v9", False), (2, "v9-rc.1", True)]
    assert P.release_items(api.limit(0), atoms.limit(0)).collect() == []


def _items(spark):
    rows = [(1, "a", "text", None, True, True), (2, "b", None, None, True, True), (3, "c", "", None, True, True), (4, "d", "text", "old", True, True), (5, "e", "text", None, False, True), (6, "f", "text", None, True, False), (7, "g", "text", None, True, True), (8, None, "t", None, True, True)]
    return spark.createDataFrame(rows, "id long, title string, summary string, ai_summary string, is_active boolean, admission_accepted boolean")


def _model(asked):
    assert asked.columns == ["id", "prompt"]
    answer = F.when(F.col("id") != 7, F.concat(F.lit(" new "), F.repeat(F.lit("y"), 2000)))
    return asked.filter("id <> 8").select("id", answer.alias("answer"), F.when(F.col("id") == 7, F.repeat(F.lit("bad token=abc "), 50)).alias("error"))


def test_summaries(spark):
    out = M.summarized(_items(spark), _model)
    got = {r.id: r for r in out.collect()}
    assert {k: r.result for k, r in got.items()} == {1: "saved", 2: "skipped", 3: "skipped", 7: "failed", 8: "failed"}
    assert got[1].text.startswith("new yyy") and len(got[1].text) == 1000 and got[8].error == "no answer"
    assert len(got[7].error) == 100 and "abc" not in got[7].error
    assert M.summary_job(out).first().asDict() == {"processed": 5, "success": 1, "failure": 2, "skipped": 2, "status": "partial_failure"}
    again = M.summarized(_items(spark), _model, retry=True)
    assert {r.id for r in again.filter("result = 'saved'").collect()} == {1, 4}
    stored = {r.id: (r.ai_summary and r.ai_summary[:3], r.ai_summary_model) for r in M.with_summaries(_items(spark), again, "m").collect()}
    assert stored == {1: ("new", "m"), 4: ("new", "m"), **{i: (None, None) for i in (2, 3, 5, 6, 7, 8)}}
    none = M.summarized(_items(spark).limit(0), _model)
    assert none.collect() == [] and M.summary_job(none).first().status == "completed"


def test_fingerprint_is_that_of_sorted_json(spark):
    row = {"b": "ü\"\\/\n", "a": None, "z": True, "c": 1.5, "list": ["x", None], "n": 7}
    df = spark.createDataFrame([tuple(row.values())], "b string, a string, z boolean, c double, list array<string>, n long").withColumn("at", F.lit(datetime(2024, 1, 2, 3, 4, 5)))
    want = hashlib.sha256(json.dumps(row | {"at": "2024-01-02T03:04:05"}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    for names in (df.columns, df.columns[::-1]):
        assert df.select(C.fingerprint({c: F.col(c) for c in names}).alias("h")).first().h == want
    assert df.select(C.fingerprint({"a": F.lit("")}).alias("h")).first().h != df.select(C.fingerprint({"a": F.col("a")}).alias("h")).first().h


@pytest.mark.parametrize("late,state", [(-1e-6, "waiting"), (0, "due"), (59.999999, "due"), (60, "missed"), (1e6, "missed")])
def test_run_states(spark, late, state):
    at = datetime(2024, 1, 1)
    assert spark.range(1).select(D.run_state(F.lit(at + timedelta(seconds=late)), F.lit(at)).alias("s")).first().s == state


def test_run_state_without_a_target(spark):
    assert spark.range(1).select(D.run_state(F.current_timestamp(), F.lit(None).cast("timestamp")).alias("s")).first().s is None


def test_rules_reclassified(spark):
    pack = [R.Rule("award_case", 2, {"won the": 10}, {}, {}), R.Rule("solicitation", 1, {}, {"apply": 10}, {})]
    rows = spark.createDataFrame([(1, 1, "They won the cup", None, "irrelevant", None), (2, 1, "Nothing", None, None, "award_case"), (3, 2, "Nothing", "apply", "solicitation", None), (4, 2, "won the", "apply apply", "solicitation", None)], "id long, source_id long, title string, summary string, category string, manual_category string")
    rows, title, summary = R.with_hits(rows, F.col("title"), F.col("summary"), pack)
    rows = rows.withColumn("r", R.decide(R.scores(title, summary, pack), F.when(F.col("source_id") == 1, "policy_industry")))
    got = {r.id: (r.category, r.automatic_category_provider, r.changed, r.manual_category, r.classification_reason) for r in R.reclassified(rows, F.col("r"), F.lit("w")).collect()}
    assert got == {1: ("award_case", "rule_based", True, None, "w"), 2: ("policy_industry", "source_default", True, "award_case", "w"), 3: ("solicitation", "rule_based", False, None, "w"), 4: ("award_case", "rule_based", True, None, "w")}
    assert {r.id for r in R.reclassified(rows, F.col("r"), F.lit("w"), 2).collect()} == {3, 4}
