"""Update runs: pages, overviews, roll-ups, period statistics and the outcome algebra."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_error


def run_page(runs: DataFrame, status: str | None = None, trigger: str | None = None, since: datetime | None = None, until: datetime | None = None, number: int = 1, limit: int = 20) -> DataFrame:
    """Newest first; the range is half open; limit is held to 1..100."""
    limit = max(1, min(100, limit))
    for name, value in (("status", status), ("trigger_kind", trigger)):
        if value:
            runs = runs.filter(F.col(name) == value)
    if since:
        runs = runs.filter(F.col("started_at") >= F.lit(since))
    if until:
        runs = runs.filter(F.col("started_at") < F.lit(until))
    return runs.orderBy(F.desc("started_at"), F.desc("id")).offset((number - 1) * limit).limit(limit)


def run_overview(runs: DataFrame, since: datetime) -> DataFrame:
    """The total is over all time, the other counts since a moment."""
    late = F.col("started_at") >= F.lit(since)
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(late & (F.col("status") == "success")).alias("succeeded"),
        F.count_if(late & (F.col("status") == "partial_success")).alias("partial"),
        F.count_if(late & (F.col("status") == "failed")).alias("failed"),
    )


def without_children(runs: DataFrame, executions: DataFrame) -> DataFrame:
    return runs.join(executions.select(F.col("run_id").alias("id")), "id", "left_anti")


def nested(runs: DataFrame, executions: DataFrame, fields: list[str]) -> DataFrame:
    """Each run with the sorted list of its executions; runs without any keep an empty list."""
    lists = executions.groupBy(F.col("run_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("executions"))
    return runs.join(lists, "id", "left").withColumn("executions", F.coalesce("executions", F.array().cast(lists.schema["executions"].dataType)))


def final_status(failed: Column, succeeded: Column, fatal: Column | None = None) -> Column:
    out = F.when(failed == 0, "success").when(succeeded > 0, "partial_success").otherwise("failed")
    return out if fatal is None else F.when(fatal, "failed").otherwise(out)


def roll_up(executions: DataFrame) -> DataFrame:
    """Sums and status of each run."""
    bad = F.count_if(F.col("status") == "failed")
    good = F.count_if(F.col("status") == "success")
    return executions.groupBy("run_id").agg(
        F.sum("new_count").alias("new_count"), F.sum("fetched_count").alias("fetched_count"), F.sum("skipped_count").alias("skipped_count"), bad.alias("failed"), good.alias("succeeded"), final_status(bad, good).alias("status")
    )


SUMS = ("discovered", "normalized", "accepted", "rejected", "classified", "new", "updated", "skipped", "unclassified", "duplicate", "failed")
SUMMARY, ERROR = 2000, 1000  #: characters of a run's error summary, and of one error in it


def finished(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Each run rolled up: source counts, the sums of SUMS, two merged histograms, status and error summary.

    results: run_id, source_id, source_name, status, error, rejection_reasons and failure_reasons (map of counts) and
    the columns of SUMS; runs: id and fatal_error, null if the run itself did not fail.  A run without results has
    zeros.  Of the errors, in order of source, only as many are gathered as fill the summary."""
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    sums = results.groupBy("run_id").agg(good.alias("source_success"), bad.alias("source_failed"), *[F.sum(c).alias(f"{c}_count") for c in SUMS])
    line = sanitize_error(F.concat_ws(": ", "source_name", "error"), ERROR)
    errors = results.filter("error IS NOT NULL AND error <> ''").select("run_id", "source_id", line.alias("line"))
    before = Window.partitionBy("run_id").orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    errors = errors.withColumn("at", F.coalesce(F.sum(F.length("line") + 2).over(before), F.lit(0))).filter(F.col("at") < SUMMARY)
    lines = errors.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_id", "line"))), lambda x: x["line"]), "; ").alias("lines"))
    out = runs.select(F.col("id").alias("run_id"), "fatal_error").join(sums, "run_id", "left").join(lines, "run_id", "left")
    for name in ("rejection_reasons", "failure_reasons"):
        counts = results.select("run_id", F.explode(name).alias("reason", "n"))
        out = out.join(histograms(counts, "run_id").select("run_id", F.col("histogram").alias(name)), "run_id", "left").withColumn(name, F.coalesce(name, F.map_from_arrays(F.array(), F.array()).cast("map<string,bigint>")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = ["source_success", "source_failed", *(f"{c}_count" for c in SUMS)]
    fatal = F.col("fatal_error").isNotNull()
    whole = F.concat_ws("; ", "lines", F.when(fatal, F.concat(F.lit("pipeline: "), sanitize_error(F.col("fatal_error"))))).alias("error_summary")
    return out.select(
        "run_id", *[zero(F.col(c)).alias(c) for c in counts], "rejection_reasons", "failure_reasons", final_status(zero(F.col("source_failed")), zero(F.col("source_success")), fatal).alias("status"),
        F.nullif(F.substring(whole, 1, SUMMARY), F.lit("")).alias("error_summary"),
    )


def primary_reason(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, reason, n): the most frequent reason, the smallest of equals."""
    return counts.groupBy(key).agg(F.min_by("reason", F.struct(-F.col("n"), F.col("reason"))).alias("reason"))


def histograms(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, reason, n) summed and turned into one map for each key."""
    return counts.groupBy(key, "reason").agg(F.sum("n").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("histogram"))


def period_stats(runs: DataFrame, executions: DataFrame, since: datetime) -> DataFrame:
    """Sums for each source over the runs since a moment."""
    recent = runs.filter(F.col("started_at") >= F.lit(since)).select(F.col("id").alias("run_id"))
    return executions.join(recent, "run_id").groupBy("source_id").agg(
        F.coalesce(F.sum("new_count"), F.lit(0)).alias("new_count"),
        F.coalesce(F.sum("fetched_count"), F.lit(0)).alias("fetched_count"),
        F.coalesce(F.sum("skipped_count"), F.lit(0)).alias("skipped_count"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") != "success").alias("not_succeeded"),
    )


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds, not under 0; null while running."""
    return F.when(end.isNotNull(), F.greatest(F.lit(0), F.floor(F.unix_micros(end) / 1e6) - F.floor(F.unix_micros(start) / 1e6)).cast("long"))


def percentage(done: Column, total: Column) -> Column:
    """Half to even; 100 of nothing."""
    return F.when(total == 0, 100).otherwise(F.bround(100.0 * done / total).cast("int"))


def job_status(failures: Column, successes: Column, skips: Column) -> Column:
    return F.when(failures == 0, "completed").when((successes > 0) | (skips > 0), "partial_failure").otherwise("failed")
