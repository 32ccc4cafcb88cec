"""The registered queries of the operators."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import Workspace, table


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"), Workspace(spark, "op1")).drop("kept")


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import repeated_words

    return repeated_words(table(spark, sf_dir, "documents"), Workspace(spark, "op3")).drop("kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "boiler_words", "text")


def op4_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolation import interpolated_scores

    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    return interpolated_scores(table(spark, sf_dir, "documents"), Workspace(spark, "op4"), fold)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "op5"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents"), Workspace(spark, "op6"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(table(spark, sf_dir, "documents"), Workspace(spark, "op8"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = importlib.import_module("public_tokenizers")
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return score(docs, fit(docs, labels, Workspace(spark, "op10"), fold != 2), fold == 2)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie, rebuilt

    ws = Workspace(spark, "op12")
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations"), ws), ws)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = importlib.import_module("public_tokenizers")
    from .token_files import read_tokens, write_tokens

    docs = table(spark, sf_dir, "documents")
    manifest = write_tokens(docs, tokenizers.path("byte_bpe_50k.json"), 2, Workspace(spark, "op13"))
    return read_tokens(manifest, dict(docs.dtypes)["doc_id"])


def queries() -> dict:
    return {
        "op1_suffix_array": op1_suffix_array,
        "op3_substring": op3_substring,
        "op2_quality_rules": op2_quality_rules,
        "op4_interpolation": op4_interpolation,
        "op5_minhash": op5_minhash,
        "op6_line_dedup": op6_line_dedup,
        "op7_decontaminate": op7_decontaminate,
        "op8_mix": op8_mix,
        "op9_token_counts": op9_token_counts,
        "op10_toxicity": op10_toxicity,
        "op11_fim": op11_fim,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_token_files": op13_token_files,
    }
