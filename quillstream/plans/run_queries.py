"""Run, execution and aggregate queries (Q-26 to Q-34, AGG-1, AGG-3, AGG-4, FN-24, FN-25, AI-8)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import times as D
from ..operators import items as I
from ..operators import runs as R
from . import fixtures as X
from .registry import query


@query(
    "run_page_filtered",
    X.WITH + "SELECT id, status, trigger_kind FROM runs WHERE status = 'success' AND trigger_kind = 'scheduled' AND started_at >= TIMESTAMP '1993-01-01' AND started_at < TIMESTAMP '1997-01-01' ORDER BY started_at DESC, id DESC LIMIT 50",
)
def run_page_filtered(spark, d):
    return R.run_page(X.runs(spark, d), "success", "scheduled", datetime(1993, 1, 1), datetime(1997, 1, 1), limit=50).select("id", "status", "trigger_kind")


@query(
    "run_overview_since",
    X.WITH
    + """SELECT count(*) AS total, count(*) FILTER (WHERE started_at >= TIMESTAMP '1995-06-01' AND status = 'success') AS succeeded, count(*) FILTER (WHERE started_at >= TIMESTAMP '1995-06-01' AND status = 'partial_success') AS partial,
    count(*) FILTER (WHERE started_at >= TIMESTAMP '1995-06-01' AND status = 'failed') AS failed FROM runs""",
)
def run_overview_since(spark, d):
    return R.run_overview(X.runs(spark, d), datetime(1995, 6, 1))


@query("runs_without_executions", X.WITH + "SELECT id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM executions e WHERE e.run_id = r.id)")
def runs_without_executions(spark, d):
    children = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return R.without_children(X.runs(spark, d), children).select("id")


@query("executions_for_runs", X.WITH + "SELECT e.run_id, e.source_id, s.s_name AS name, e.status FROM executions e JOIN supplier s ON e.source_id = s.s_suppkey JOIN runs r ON e.run_id = r.id WHERE r.status = 'failed'")
def executions_for_runs(spark, d):
    failed = X.runs(spark, d).filter("status = 'failed'").select(F.col("id").alias("run_id"))
    names = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    return X.executions(spark, d).join(failed, "run_id", "left_semi").join(names, "source_id").select("run_id", "source_id", "name", "status")


@query(
    "source_recent_runs_top5",
    X.WITH
    + "SELECT source_id, run_id, CAST(rank AS INTEGER) AS rank FROM (SELECT e.source_id, e.run_id, row_number() OVER (PARTITION BY e.source_id ORDER BY r.started_at DESC, r.id DESC) AS rank FROM executions e JOIN runs r ON e.run_id = r.id) WHERE rank <= 5",
)
def source_recent_runs(spark, d):
    rows = X.executions(spark, d).join(X.runs(spark, d).select("id", "started_at"), F.col("run_id") == F.col("id"))
    return I.top_per_key(rows, "source_id", 5, [F.desc("started_at"), F.desc("id")]).select("source_id", "run_id", "rank")


@query(
    "source_period_stats",
    X.WITH
    + """SELECT e.source_id, CAST(coalesce(sum(e.new_count), 0) AS BIGINT) AS new_count, CAST(coalesce(sum(e.fetched_count), 0) AS BIGINT) AS fetched_count, CAST(coalesce(sum(e.skipped_count), 0) AS BIGINT) AS skipped_count,
    count(*) FILTER (WHERE e.status = 'success') AS succeeded, count(*) FILTER (WHERE e.status <> 'success') AS not_succeeded
    FROM executions e JOIN runs r ON e.run_id = r.id WHERE r.started_at >= TIMESTAMP '1996-01-01' GROUP BY e.source_id""",
)
def source_period_stats(spark, d):
    return R.period_stats(X.runs(spark, d), X.executions(spark, d), datetime(1996, 1, 1))


@query("execution_count_by_source", X.WITH + "SELECT source_id, count(*) AS n FROM executions GROUP BY source_id")
def execution_count_by_source(spark, d):
    return X.executions(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("run_ids_by_source", "SELECT DISTINCT l_suppkey AS source_id, l_orderkey AS run_id FROM lineitem")
def run_ids_by_source(spark, d):
    return X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("run_id")).distinct()


@query(
    "run_with_nested_executions",
    X.WITH
    + "SELECT r.id, r.status, coalesce(string_agg(concat(CAST(e.source_id AS VARCHAR), ':', e.status, ':', CAST(e.new_count AS VARCHAR)), ',' ORDER BY e.source_id) FILTER (WHERE e.run_id IS NOT NULL), '') AS executions FROM runs r LEFT JOIN executions e ON e.run_id = r.id GROUP BY r.id, r.status",
)
def run_with_nested_executions(spark, d):
    rows = R.nested(X.runs(spark, d).select("id", "status"), X.executions(spark, d), ["source_id", "status", "new_count"])
    text = F.array_join(F.transform("executions", lambda e: F.concat_ws(":", e["source_id"], e["status"], e["new_count"])), ",")
    return rows.select("id", "status", text.alias("executions"))


@query(
    "run_rollup_status",
    X.WITH
    + """SELECT run_id, CAST(sum(new_count) AS BIGINT) AS new_count, CAST(sum(fetched_count) AS BIGINT) AS fetched_count, CAST(sum(skipped_count) AS BIGINT) AS skipped_count, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'success') AS succeeded, CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'success' WHEN count(*) FILTER (WHERE status = 'success') > 0 THEN 'partial_success' ELSE 'failed' END AS status
    FROM executions GROUP BY run_id""",
)
def run_rollup_status(spark, d):
    return R.roll_up(X.executions(spark, d))


_REASONS = "SELECT l_suppkey AS source_id, concat(l_returnflag, l_linestatus) AS reason, count(*) AS n FROM lineitem GROUP BY l_suppkey, concat(l_returnflag, l_linestatus)"


def _reasons(spark, d):
    return X.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.concat("l_returnflag", "l_linestatus").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("primary_reason", f"SELECT source_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, reason) AS k FROM ({_REASONS})) WHERE k = 1")
def primary_reason(spark, d):
    return R.primary_reason(_reasons(spark, d), "source_id")


@query("reason_histograms", f"SELECT source_id, string_agg(concat(reason, '=', CAST(n AS VARCHAR)), ',' ORDER BY reason) AS histogram FROM ({_REASONS}) GROUP BY source_id")
def reason_histograms(spark, d):
    rows = R.histograms(_reasons(spark, d), "source_id")
    entries = F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("source_id", F.array_join(entries, ",").alias("histogram"))


@query(
    "run_progress",
    X.WITH
    + """SELECT run_id, CASE WHEN sum(fetched_count) = 0 THEN 100 ELSE CAST(round_even(100.0 * sum(skipped_count) / sum(fetched_count), 0) AS INTEGER) END AS percent,
    CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE status = 'success') > 0 OR sum(skipped_count) > 0 THEN 'partial_failure' ELSE 'failed' END AS status FROM executions GROUP BY run_id""",
)
def run_progress(spark, d):
    rows = R.roll_up(X.executions(spark, d))
    return rows.select("run_id", R.percentage(F.col("skipped_count"), F.col("fetched_count")).alias("percent"), R.job_status(F.col("failed"), F.col("succeeded"), F.col("skipped_count")).alias("status"))


@query(
    "turn_durations",
    "SELECT user_id, CAST(greatest(0, epoch_us(max(ts)) // 1000000 - epoch_us(min(ts)) // 1000000) AS BIGINT) AS seconds FROM events GROUP BY user_id",
)
def turn_durations(spark, d):
    rows = X.table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return rows.select("user_id", R.duration_seconds(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("seconds"))


# a result for each run and supplier, failed where a line was returned; every ninth run breaks as a whole, and some have no results
_RESULTS = """results AS (SELECT l_orderkey AS run_id, l_suppkey AS source_id, concat('source ', CAST(l_suppkey AS VARCHAR)) AS source_name, CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN 'failed' ELSE 'success' END AS status,
CASE WHEN max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN concat('timeout after ', repeat('very ', 50 * (l_suppkey % 4)), 'long') END AS error, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS discovered, count(*) AS normalized, CAST(sum(l_linenumber) AS BIGINT) AS accepted,
CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS rejected, count(*) FILTER (WHERE l_returnflag = 'A') AS an, count(*) FILTER (WHERE l_returnflag = 'N') AS nn, count(*) FILTER (WHERE l_returnflag = 'R') AS rn, count(*) FILTER (WHERE l_linestatus = 'F') AS fn FROM lineitem GROUP BY l_orderkey, l_suppkey)"""
_SUMMED = {"discovered": "discovered", "normalized": "normalized", "accepted": "accepted", "rejected": "rejected", "classified": "an + nn", "new": "an", "updated": "nn", "skipped": "rn", "unclassified": "fn", "duplicate": "rejected + fn", "failed": "2 * rn"}


def _results(spark, d):
    lines = X.table(spark, d, "lineitem")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    rows = lines.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("source_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("discovered"), F.count(F.lit(1)).alias("normalized"), F.sum("l_linenumber").alias("accepted"), is_("l_linestatus", "O").alias("rejected"),
        is_("l_returnflag", "A").alias("an"), is_("l_returnflag", "N").alias("nn"), is_("l_returnflag", "R").alias("rn"), is_("l_linestatus", "F").alias("fn"),
    )
    error = F.when(F.col("rn") > 0, F.concat(F.lit("<b>timeout</b>  after "), F.expr("repeat('very ', CAST(50 * (source_id % 4) AS INT))"), F.lit("long")))
    reasons = F.map_filter(F.create_map(F.lit("a"), F.col("an"), F.lit("n"), F.col("nn")), lambda _, v: v > 0)
    failures = F.when(F.col("rn") > 0, F.create_map(F.concat(F.lit("kind"), (F.col("source_id") % 3).cast("string")), F.col("rn")))
    rows = rows.withColumns({c: F.expr(e) for c, e in _SUMMED.items() if c not in ("discovered", "normalized", "accepted", "rejected")})
    return rows.select("run_id", "source_id", F.concat(F.lit("source "), F.col("source_id").cast("string")).alias("source_name"), F.when(F.col("rn") > 0, "failed").otherwise("success").alias("status"), error.alias("error"), reasons.alias("rejection_reasons"), failures.alias("failure_reasons"), *_SUMMED)


_MERGED = "SELECT run_id, string_agg(concat(k, '=', CAST(n AS VARCHAR)), ',' ORDER BY k) AS h FROM (SELECT run_id, k, sum(n) AS n FROM ({}) WHERE n > 0 GROUP BY run_id, k) GROUP BY run_id"


@query(
    "run_finished",
    X.WITH + f""", {_RESULTS}, s AS (SELECT run_id, count(*) FILTER (WHERE status = 'success') AS source_success, count(*) FILTER (WHERE status = 'failed') AS source_failed, {', '.join(f"CAST(sum({e}) AS BIGINT) AS {c}_count" for c, e in _SUMMED.items())},
    string_agg(concat(source_name, ': ', error), '; ' ORDER BY source_id) FILTER (WHERE error IS NOT NULL) AS lines FROM results GROUP BY run_id),
    a AS ({_MERGED.format("SELECT run_id, 'a' AS k, an AS n FROM results UNION ALL SELECT run_id, 'n', nn FROM results")}), b AS ({_MERGED.format("SELECT run_id, concat('kind', CAST(source_id % 3 AS VARCHAR)) AS k, rn AS n FROM results")})
    SELECT r.id AS run_id, coalesce(source_success, 0) AS source_success, coalesce(source_failed, 0) AS source_failed, {', '.join(f'coalesce({c}_count, 0) AS {c}_count' for c in _SUMMED)}, coalesce(a.h, '') AS rejections, coalesce(b.h, '') AS failures,
    CASE WHEN r.id % 9 = 0 THEN 'failed' WHEN coalesce(source_failed, 0) = 0 THEN 'success' WHEN source_success > 0 THEN 'partial_success' ELSE 'failed' END AS status,
    nullif(substr(concat_ws('; ', lines, CASE WHEN r.id % 9 = 0 THEN 'pipeline: broken token=***' END), 1, 2000), '') AS error_summary FROM runs r LEFT JOIN s ON s.run_id = r.id LEFT JOIN a ON a.run_id = r.id LEFT JOIN b ON b.run_id = r.id""",
)
def run_finished(spark, d):
    runs = X.runs(spark, d).select("id", F.when(F.col("id") % 9 == 0, F.lit("broken  token=abc123")).alias("fatal_error"))
    out = R.finished(_results(spark, d), runs)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumns({"rejections": text("rejection_reasons"), "failures": text("failure_reasons")}).drop("rejection_reasons", "failure_reasons")


@query("scheduled_states", "SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 90 < 15 THEN 'waiting' WHEN event_id % 90 < 75 THEN 'due' ELSE 'missed' END AS state FROM events")
def scheduled_states(spark, d):
    rows = X.table(spark, d, "events").withColumn("now", F.col("ts").cast("timestamp"))
    target = F.when(F.col("event_id") % 4 != 3, F.timestamp_micros(F.unix_micros("now") - (F.col("event_id") % 90 - 15) * 1_000_000))
    return rows.select(F.col("event_id").alias("id"), D.run_state(F.col("now"), target).alias("state"))
