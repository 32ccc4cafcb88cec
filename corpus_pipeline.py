"""The corpus pipeline: each stage works on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.decontaminate import decontaminate as _decontaminate
from quillstream.llm.frames import Workspace, shared_dir, table
from quillstream.llm.line_dedup import line_dedup as _line_dedup
from quillstream.llm.mixing import mix as _mix
from quillstream.llm.quality import passing as _passing


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or have too few lines of their own go; the others lose their host's repeated lines, and n_chars follows."""
    out = _passing(docs, Workspace(spark, "quality"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text; a document left without a word goes."""
    out = _line_dedup(docs, Workspace(spark, "lines")).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id."""
    from quillstream.llm.minhash import keep_one

    return keep_one(docs, Workspace(spark, "near")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words, in whole copies, the mix takes of each document."""
    return _mix(docs, Workspace(spark, "mixture"))


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: Edit distance, entropy balancing and the order of rounding have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
