"""Batches for a language model: chunks, contexts, answers and their validation; the provider itself is a plug-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domains import CATEGORIES
from ..functions.text import sanitize_error
from .runs import job_status
from .upsert import checkpointed

PER_REQUEST = 15
ANSWER = "id long, category string, confidence double"


def chunks(items: DataFrame, size: int = PER_REQUEST, key: str = "source_id") -> DataFrame:
    """items with a chunk number within each key, by id."""
    return items.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1) / size))


def context(*parts: Column, most: int = 1600) -> Column:
    """Distinct non-empty parts, one a line, cut to `most` characters."""
    kept = F.array_distinct(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p.isNotNull() & (p != "")))
    return F.substring(F.array_join(kept, "\n"), 1, most)


def prompts(items: DataFrame) -> DataFrame:
    """One request for each source and chunk."""
    return chunks(items).groupBy("source_id", "chunk").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "title", "summary")))).alias("prompt"))


def validate_batch(expected: DataFrame, answers: DataFrame) -> DataFrame:
    """expected ids with the answer that came for each: ok, missing, duplicate_id, bad_category or bad_confidence."""
    rows = answers.select(F.from_json("answer", ANSWER).alias("a")).select("a.*").filter("id is not null")
    per_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("category"), F.max("confidence").alias("confidence"))
    result = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate_id").when(~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False)), "bad_category")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "bad_confidence").otherwise("ok")
    )
    return expected.join(per_id, "id", "left").withColumn("result", result)


def unknown_ids(expected: DataFrame, answers: DataFrame) -> DataFrame:
    return answers.select(F.from_json("answer", ANSWER)["id"].alias("id")).filter("id is not null").join(expected, "id", "left_anti").distinct()


def saved_score(confidence: Column, quick: Column) -> Column:
    return F.when(~quick, confidence * 10)


def verdict(answer: Column, categories: list[str] = CATEGORIES) -> Column:
    """category, score (ten times the confidence), is_ambiguous (confidence under 0.6) and error of a model's JSON answer.

    An answer that is no JSON, names no known category or has no confidence from 0 to 1 is unclassified with score 0."""
    v = F.try_parse_json(answer)
    category = F.try_variant_get(v, "$.category", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.confidence", "variant"))
    confidence = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.confidence", "double"))
    error = (
        F.when(v.isNull(), "invalid JSON").when(category.isNull(), "category missing").when(~category.isin(categories), "unknown category")
        .when(confidence.isNull(), "confidence is no number").when(~confidence.between(0, 1), "confidence out of range")
    )
    good = error.isNull()
    reason = F.substring(F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")), 1, 200)
    return F.struct(
        F.when(good, category).otherwise("unclassified").alias("category"), F.when(good, confidence * 10).otherwise(0.0).alias("score"),
        F.coalesce(good & (confidence < 0.6), F.lit(False)).alias("is_ambiguous"), F.when(good, reason).alias("reason"), error.alias("error"),
    )


def two_rounds(items: DataFrame, first, second, doubtful) -> DataFrame:
    """id, category, confidence, round: a first round over titles, a second with summaries for what it leaves in doubt.

    first and second take items and return id, category, confidence; an item without an answer is in doubt.  Only items
    with a summary are asked again; what the second round does not answer is unclassified."""
    asked = items.join(first(items).select("id", F.col("category").alias("_c"), F.col("confidence").alias("_k")), "id", "left")
    judged = asked.select(*[F.col(c) for c in items.columns if c not in ("category", "confidence")], F.col("_c").alias("category"), F.col("_k").alias("confidence"))
    again = F.coalesce(doubtful(F.col("category")), F.lit(True)) & (F.coalesce(F.col("summary"), F.lit("")) != "")
    judged = judged.withColumn("_again", again)
    redone = second(judged.filter("_again").drop("_again")).select("id", F.col("category").alias("_c"), F.col("confidence").alias("_k"))
    out = judged.join(redone, "id", "left")
    pick = lambda new, old: F.when(F.col("_again"), F.col(new)).otherwise(F.col(old))
    return out.select("id", F.coalesce(pick("_c", "category"), F.lit("unclassified")).alias("category"), pick("_k", "confidence").alias("confidence"), F.when(F.col("_again"), 2).otherwise(1).alias("round"))


class Limited(Exception):
    """The provider asks to wait."""


def ask_resiliently(rows: list, ask, retries: int = 2, depth: int = 4, wait=None) -> dict:
    """What ask(rows) answers, as a dict by position; a limit is waited out 2**n seconds (8 at most), and a batch whose
    answer cannot be read (ValueError) is asked in halves, `depth` times at most.  What stays unanswered is missing."""
    for attempt in range(retries + 1):
        try:
            return dict(enumerate(ask(rows)))
        except Limited:
            if attempt < retries and wait:
                wait(min(8, 2**attempt))
        except ValueError:
            if depth == 0 or len(rows) < 2:
                return {}
            half = len(rows) // 2
            left, right = (ask_resiliently(part, ask, retries, depth - 1, wait) for part in (rows[:half], rows[half:]))
            return left | {k + half: v for k, v in right.items()}
    return {}


def answered(items: DataFrame, ask, size: int = PER_REQUEST) -> DataFrame:
    """items(id, title, summary) with the answer text that the provider gave, null for none.

    ask: list of rows -> list of texts; requests hold `size` rows and run in the tasks that hold the items."""
    import time

    schema = "id long, answer string"

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), size):
                rows = list(pdf.iloc[a : a + size].itertuples(index=False))
                got = ask_resiliently(rows, ask, wait=time.sleep)
                yield type(pdf)({"id": [r.id for r in rows], "answer": [got.get(i) for i in range(len(rows))]})

    return items.select("id", "title", "summary").mapInPandas(run, schema)


SUMMARY = 1000  #: characters of a stored summary


def summary_prompt(title: Column, summary: Column) -> Column:
    return F.concat(F.lit("Sum up this item in two or three sentences, from the given text alone, and answer with these sentences only.\nTitle: "), F.coalesce(title, F.lit("")), F.lit("\nText: "), summary)


def summarized(items: DataFrame, complete, retry: bool = False) -> DataFrame:
    """id, result, text, error of every item that may be summed up: active, accepted, and without a summary unless retry.

    complete takes id, prompt and returns id, answer, error; it is asked once and what it says is written before it is
    used, as a second answer may be another.  result is saved, skipped (nothing to sum up) or failed (an error, or no
    answer); a text is cut to SUMMARY characters, an error safe to show.  Ids must be distinct."""
    wanted = items.filter("is_active AND admission_accepted" + ("" if retry else " AND ai_summary IS NULL"))
    text = F.coalesce("summary", F.lit("")) != ""
    asked = wanted.filter(text).select("id", summary_prompt(F.col("title"), F.col("summary")).alias("prompt"))
    got = checkpointed(complete(asked).select("id", "answer", "error"))
    rows = wanted.select("id", text.alias("_text")).join(got, "id", "left")
    failed = F.col("error").isNotNull() | F.col("answer").isNull()
    result = F.when(~F.col("_text"), "skipped").when(failed, "failed").otherwise("saved")
    rows = rows.withColumn("result", result)
    error = F.when(F.col("result") == "failed", F.coalesce(sanitize_error(F.col("error"), 100), F.lit("no answer")))
    return rows.select("id", "result", F.when(F.col("result") == "saved", F.substring(F.trim("answer"), 1, SUMMARY)).alias("text"), error.alias("error"))


def with_summaries(items: DataFrame, results: DataFrame, model: str) -> DataFrame:
    """items with the saved texts of summarized() as ai_summary, and the model they are by in ai_summary_model."""
    saved = results.filter("result = 'saved'").select("id", F.col("text").alias("_text"))
    out = items.join(saved, "id", "left")
    old = F.col("ai_summary_model") if "ai_summary_model" in items.columns else F.lit(None).cast("string")
    return out.withColumns({"ai_summary": F.coalesce("_text", "ai_summary"), "ai_summary_model": F.when(F.col("_text").isNotNull(), model).otherwise(old)}).drop("_text")


def summary_job(results: DataFrame) -> DataFrame:
    """The counts and the status of one run of summarized()."""
    n = {c: F.count_if(F.col("result") == r) for c, r in (("success", "saved"), ("failure", "failed"), ("skipped", "skipped"))}
    counted = results.agg(F.count(F.lit(1)).alias("processed"), *[c.alias(k) for k, c in n.items()])
    return counted.withColumn("status", job_status(F.col("failure"), F.col("success"), F.col("skipped")))
