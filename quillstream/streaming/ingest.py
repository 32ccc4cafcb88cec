"""Incremental ingest: each micro-batch merges into a snapshot; late rows are counted, not lost silently."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import ItemStore


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter("k = 1").drop("k")


def merged(stored: DataFrame | None, batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; a replayed batch changes nothing."""
    return latest(batch if stored is None else stored.unionByName(batch), key, order)


def ingest(stream: DataFrame, root: str, key: str, order: list[str], checkpoint: str):
    """Snapshots root/v<batch>; a reader takes the newest one that is complete.  Ends when the input is used up."""

    def apply(batch: DataFrame, number: int) -> None:
        old = snapshot(batch.sparkSession, root, below=number)
        merged(old, batch, key, order).write.mode("overwrite").parquet(f"{root}/v={number:09d}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """The newest complete snapshot, listed through Hadoop so that any store works."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS")) and (below is None or int(n[2:]) < below)]
    return spark.read.parquet(f"{root}/{max(done)}") if done else None


def ingest_items(stream: DataFrame, store: ItemStore, name: str, checkpoint: str):
    """Persists a stream of collected rows (operators/store.py) in batches as they come; ends when the input is used up.

    A batch that the store has already, as its number says, is not applied again, and a run that comes in several
    batches is still one run: the store is the same whatever way the stream is cut."""

    def apply(batch: DataFrame, number: int) -> None:
        store.persist(batch, (name, number))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, lateness: str = "2 days", width: str = "1 day") -> DataFrame:
    """Event-time counts with a watermark."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def late_rows(batch: DataFrame, since: datetime) -> DataFrame:
    """How many rows of each type a look-back window leaves out; rows without a time stay in."""
    return batch.groupBy("event_type").agg(F.count_if(F.col("ts") < F.lit(since)).alias("late"), F.count(F.lit(1)).alias("total"))
