"""Quality rules: per-text counts and the cross-document line frequency rule, all as Spark expressions.

The line rule: normalise each line (lower case, runs of white space to one blank, trimmed), hash it, and
count for each host the distinct texts that hold it.  A line in more than max(min_docs, max_share of the
host's texts) of them is boilerplate and is removed; a document that keeps less than min_left of its words
is depleted and rejected.  Exact copies of a text count once, so a copied clean document is no boilerplate.

Defined results: null or empty text has no words and fails the base rules; a null host is a host of its
own; rows that repeat count as one document and each gets the same result; other columns pass through
passing() and are ignored by quality_rules().  Lines without a word are never boilerplate and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Workspace

SPACES = r"[\x20\x09-\x0D]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda x: x != "")


def content_lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words inside windows of n words that occur at least twice in the list."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            pairs,
            lambda s: F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]), x["i"]
                    ),
                ),
                lambda p: p.isNotNull(),
            ),
        )
        return F.aggregate(
            F.sort_array(twice),
            F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["total"] + n - F.greatest(F.lit(0), a["end"] - p)).alias("total"), (p + n).alias("end")),
            lambda a: a["total"],
        )

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
        found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
        return F.when(F.size(w) <= n, F.lit(0)).otherwise(found)

    return let(words, count)


def text_counts(text: Column) -> list[Column]:
    full = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lines = content_lines(text)
    return [
        let(words, F.size).cast("long").alias("n_words"),
        F.length(F.regexp_replace(full, SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(full, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(words).cast("long").alias("n_repeat_words"),
    ]


def _body() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.length("text"))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def _judged(docs: DataFrame, ws: Workspace, host: str, min_docs: int, max_share: float, min_left: float) -> DataFrame:
    """row (all columns of docs), host, body, the counts, boiler_words, base_failed, kept and text without the boilerplate lines.

    Line hashes are shuffled pre-aggregated by text; each text is shuffled once, to meet the lines that it loses.
    """
    key = _body()
    normal = F.transform(content_lines(F.col("text")), normal_line)
    per_line = F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))
    lines = (
        docs.select(F.col(host).alias("host"), key.alias("body"), F.explode(per_line).alias("x"))
        .groupBy("host", "body", "x.line", "x.words")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    # repeated rows of a text hold its lines as many times each: one of them is enough
    copies = docs.groupBy(F.col(host).alias("host"), key.alias("body")).agg(F.count(F.lit(1)).alias("copies"))
    lines = ws.save(lines, "lines")
    copies = ws.save(copies, "copies")
    limit = copies.groupBy("host").agg(F.greatest(F.lit(float(min_docs)), F.lit(max_share) * F.count(F.lit(1))).alias("most"))
    frequent = lines.groupBy("host", "line").agg(F.count_distinct("body").alias("n"))
    # a line that may exceed its limit at all is in more than min_docs texts
    frequent = (
        frequent.filter(F.col("n") > min_docs)
        .join(limit.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
        .filter(F.col("n") > F.col("most"))
        .select(F.col("host").alias("fh"), F.col("line").alias("fl"))
    )
    boiler = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("fh")) & (F.col("line") == F.col("fl")))
        .groupBy("host", "body")
        .agg(F.sum(F.col("words") * F.col("times")).alias("w"), F.collect_set("line").alias("gone"))
        .join(copies.select(F.col("host").alias("ch"), F.col("body").alias("cb"), "copies"), F.col("host").eqNullSafe(F.col("ch")) & (F.col("body") == F.col("cb")))
        .select(F.col("host").alias("_host"), F.col("body").alias("_body"), (F.col("w") / F.col("copies")).cast("long").alias("boiler_words"), "gone")
    )
    boiler = ws.save(boiler, "boiler")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("host"), key.alias("body"), *text_counts(F.col("text"))).withColumn("base_failed", failed)
    left = F.col("n_words") - F.col("boiler_words")
    text = F.col("row.text")
    own = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(normal_line(x)))), "\n")
    return (
        counts.join(boiler.hint("merge"), F.col("host").eqNullSafe(F.col("_host")) & (F.col("body") == F.col("_body")), "left")
        .withColumn("boiler_words", F.coalesce("boiler_words", F.lit(0)))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))
        .withColumn("text", F.when(F.col("gone").isNull(), text).otherwise(own))
        .drop("_host", "_body", "gone")
    )


def quality_rules(
    docs: DataFrame, ws: Workspace, host: str = "source", min_docs: int = 10, max_share: float = 0.02, min_left: float = 0.3
) -> DataFrame:
    """doc_id, host, body (a hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, boiler_words, kept,
    text (without its boilerplate lines; the counts are those of the whole text)."""
    rows = _judged(docs.select(*dict.fromkeys(["doc_id", host, "text"])), ws, host, min_docs, max_share, min_left)
    return rows.select(F.col("row.doc_id").alias("doc_id"), *[c for c in rows.columns if c != "row"])


def passing(
    docs: DataFrame, ws: Workspace, host: str = "source", min_docs: int = 10, max_share: float = 0.02, min_left: float = 0.3
) -> DataFrame:
    """The documents that the quality rules keep, their texts without the boilerplate lines."""
    rows = _judged(docs, ws, host, min_docs, max_share, min_left).filter("kept")
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
