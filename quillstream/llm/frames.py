"""Spark plumbing shared by the operators: tables and intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL_MAPS = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    A local session may do without, since its one process sees its own temporary folder; on a cluster every
    executor would write to its own disk, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/quillstream-shared"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs inside, put back afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def small_maps(spark: SparkSession):
    """Joins whose shuffled partitions all turn out small probe hash maps rather than sort; others still sort."""
    return setting(spark, SMALL_MAPS, "64m")


class Workspace:
    """Intermediate tables, written once to the shared folder so that a lost executor costs no upstream work.

    Each table is read back as a plain Parquet scan, which cuts the lineage and fixes its statistics; the shuffle
    files behind it go once it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{self.root}/{uuid.uuid4().hex[:8]}-{name}"
        with setting(self.spark, CLEAN, "true"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have, as a user's columns may be called anything."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
