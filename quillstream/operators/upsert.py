"""The two-key upsert: match a batch against the stored items and itself, as a sequential fold would.

A row matches a stored item by canonical address (globally), else by source and fingerprint.  Rows that match
nothing insert, and only inserted rows make their keys matchable: which rows insert follows from rounds of
aggregates and joins over distinct keys.  operators/store.py persists batches by these rules.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROUNDS, FEW = 8, 200_000  #: after so many rounds, so few rows that are left are settled in order in one task


def match(batch: DataFrame, store: DataFrame) -> DataFrame:
    """batch with stored_id and stored_source, by address first, then by (source, fingerprint)."""
    by_url = store.select(F.col("canonical_url").alias("u"), F.col("id").alias("url_id"), F.col("source_id").alias("url_source"))
    by_print = store.select(F.col("source_id").alias("ps"), F.col("fingerprint").alias("pf"), F.col("id").alias("print_id"))
    out = batch.join(by_url, F.col("canonical_url") == F.col("u"), "left").join(by_print, (F.col("source_id") == F.col("ps")) & (F.col("fingerprint") == F.col("pf")), "left")
    return out.withColumn("stored_id", F.coalesce("url_id", "print_id")).withColumn(
        "stored_source", F.when(F.col("url_id").isNotNull(), F.col("url_source")).when(F.col("print_id").isNotNull(), F.col("source_id"))
    ).drop("u", "url_id", "url_source", "ps", "pf", "print_id")


def anchors(rows: DataFrame, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """canonical_url, source_id, fingerprint and rowno of the rows that insert, for rows whose keys are not null.

    A row inserts if no earlier inserted row has its address or its source and fingerprint.  Rows alike in all three
    keys stand for one, so that a hot address or fingerprint is as many rows as it has partners.  In each round the
    rows that come first in both groups insert, and all that share a key with them are settled; what is left is
    decided among itself.  A round is two aggregates and two joins, whatever the size of a group; only a long chain
    of rows that share now one key, now the other needs many, and its end, if small, is settled row by row.
    save: cuts a round's lineage, checkpointed() by default."""
    save = save or checkpointed
    keys = ["canonical_url", "source_id", "fingerprint"]
    left = save(rows.groupBy(*keys).agg(F.min("rowno").alias("rowno")))
    out = None
    for turn in itertools.count():
        if turn >= ROUNDS and left.count() <= FEW:
            return out.unionByName(left.coalesce(1).groupBy().applyInPandas(_in_order, left.schema))
        by_url = left.groupBy("canonical_url").agg(F.min("rowno").alias("_u"))
        by_mark = left.groupBy("source_id", "fingerprint").agg(F.min("rowno").alias("_f"))
        found = left.join(by_url, "canonical_url").join(by_mark, ["source_id", "fingerprint"]).filter("rowno = _u AND rowno = _f").select(*keys, "rowno")
        found = save(found)
        out = found if out is None else out.unionByName(found)
        left = save(left.join(found.select("canonical_url"), "canonical_url", "left_anti").join(found.select("source_id", "fingerprint"), ["source_id", "fingerprint"], "left_anti"))
        if left.isEmpty():
            return out


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    urls, marks, kept = set(), set(), []
    rows = rows.sort_values("rowno")
    for i, (url, mark) in enumerate(zip(rows["canonical_url"], zip(rows["source_id"], rows["fingerprint"]))):
        if url not in urls and mark not in marks:
            urls.add(url), marks.add(mark), kept.append(i)
    return rows.iloc[kept]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session may do with its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/quillstream-shared").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def write_files(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = None) -> None:
    """df as small Parquet files, in folders by a column if one is given; the shuffle files behind it go once it is written."""
    conf = df.sparkSession.conf
    old = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        writer = df.write.mode(mode).option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        conf.unset(CLEAN) if old is None else conf.set(CLEAN, old)


class Work:
    """Intermediate tables of one job, each as files in a folder below root that its owner drops."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.number = spark, root, itertools.count()

    def _path(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str | None = None, by: str | None = None) -> DataFrame:
        """df without its lineage."""
        name = name or f"t{next(self.number)}"
        write_files(df, f"{self.root}/{name}", by=by)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def bytes(self, name: str) -> int:
        fs, path = self._path(name)
        return fs.getContentSummary(path).getLength()

    def drop(self, name: str = "") -> None:
        """Removes a table that no later step reads, or all."""
        fs, path = self._path(name)
        fs.delete(path, True)


def first_wins(rows: DataFrame, save: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rowno, into: the row that each unmatched row of a batch merges into, itself if it inserts.

    Of the inserted rows before it, the one with its address, else the one with its source and fingerprint.  A null
    address or fingerprint equals no other, nor does a fingerprint without a source."""
    own = F.concat(F.lit("\0"), F.col("rowno").cast("string"))
    mark = F.when(F.col("source_id").isNull(), own).otherwise(F.coalesce("fingerprint", own))
    rows = rows.select("rowno", F.coalesce("source_id", F.lit(-1)).alias("source_id"), F.coalesce("canonical_url", own).alias("canonical_url"), mark.alias("fingerprint"))
    found = anchors(rows, save)
    by_url = found.select("canonical_url", F.col("rowno").alias("_u"))
    by_mark = found.select("source_id", "fingerprint", F.col("rowno").alias("_f"))
    out = rows.join(by_url, "canonical_url", "left").join(by_mark, ["source_id", "fingerprint"], "left")
    earlier = [F.when(F.col(c) <= F.col("rowno"), F.col(c)) for c in ("_u", "_f")]
    return out.select("rowno", F.coalesce(*earlier).alias("into"))


def revision(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Names of the content fields that changed, null-safe; the fingerprint and the addresses never change."""
    return F.array_compact(F.array(*[F.when(~old[c].eqNullSafe(new[c]), F.lit(c)) for c in old]))


def outcome(stored_source: Column, source: Column, changed: Column, in_batch: Column) -> Column:
    """new, in_batch_duplicate, updated or skipped; hits of another source's item are skipped."""
    return (
        F.when(in_batch, "in_batch_duplicate").when(stored_source.isNull(), "new").when(stored_source != source, "skipped").when(F.size(changed) > 0, "updated").otherwise("skipped")
    )


def counters(rows: DataFrame, *by: str) -> DataFrame:
    """rows(outcome, category) as counts, one row for each value of `by`; unchanged and cross-source hits count as skipped
    and as duplicate, invalid rows as skipped."""
    is_ = lambda *x: F.count_if(F.col("outcome").isin(*x))
    return rows.groupBy(*by).agg(
        is_("new").alias("new"), is_("updated").alias("updated"), is_("skipped", "invalid").alias("skipped"), is_("skipped", "in_batch_duplicate").alias("duplicate"),
        F.count_if((F.col("outcome") != "in_batch_duplicate") & (F.col("category") == "unclassified")).alias("unclassified"),
    )


def discoveries(hits: DataFrame) -> DataFrame:
    """item_id, source_id, at -> first and last sighting of an item by each source."""
    return hits.groupBy("item_id", "source_id").agg(F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.count(F.lit(1)).alias("times"))
