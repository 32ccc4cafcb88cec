"""Line dedup with overlapping windows of three lines.

Lines without a word are passed over; the others are trimmed and each run of three consecutive ones is a
window.  Of a window that occurs more than once in the corpus the first occurrence, by (doc_id, position),
stays; the lines that later occurrences cover are removed.  Overlapping occurrences merge by position.

Defined results: null or empty texts and texts of fewer than three such lines keep everything; rows that
repeat a document (doc_id and text) are one document, each gets the same result; null doc_ids sort first;
other columns pass through, but n_lines and n_removed, which the result has of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import Workspace, unused
from .quality import SPACES, let

LINES = 3


def line_dedup(docs: DataFrame, ws: Workspace) -> DataFrame:
    """docs with text rewritten, plus n_lines (lines with a word) and n_removed.

    One shuffle of window hashes finds repeats (combined before it), one joins them back, one brings the
    covered positions to the texts.
    """
    at, own, gone, key = unused(docs, "at", "own", "gone", "key")
    body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.length("text"))
    trimmed = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, rf"^{SPACES}|{SPACES}$", ""))
    numbered = F.filter(F.transform(trimmed, lambda x, i: F.struct(F.xxhash64(x).alias("h"), i.alias("at"), (x != "").alias("w"))), lambda x: x["w"])
    spans = let(
        numbered,
        lambda a: F.when(
            F.size(a) >= LINES,
            F.transform(
                F.sequence(F.lit(0), F.size(a) - LINES),
                lambda i: F.struct(
                    F.xxhash64(*[F.get(a, i + j)["h"] for j in range(LINES)]).alias("window"),
                    i.alias("pos"),
                    F.transform(F.sequence(i, i + LINES - 1), lambda k: F.get(a, k)["at"]).alias("lines"),
                ),
            ),
        ),
    )
    windows = ws.save(docs.select("doc_id", body.alias("body"), F.explode(spans).alias("x")).select("doc_id", "body", "x.*"), "windows")
    place = F.struct("doc_id", "body", "pos")
    first = windows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("final")).filter(F.col("first") != F.col("final"))
    covered = (
        windows.join(first.select("window", "first").hint("merge"), "window")
        .filter(F.col("first") != place)
        .groupBy(F.col("doc_id").alias(at), F.col("body").alias(own))
        .agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias(gone))
    )
    out = docs.withColumn(key, body).join(covered.hint("merge"), F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(key) == F.col(own)), "left")
    # by sets of positions: a long text with many covered lines is not searched once a line
    kept = let(
        F.split(F.col("text"), "\n"),
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n"),
    )
    return out.select(
        *[docs[c] if c != "text" else F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.size(numbered).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
