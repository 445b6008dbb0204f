"""Queries of the corpus operators, as registered by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, lines, neighbours, oracles, packing, quality, secrets, simhash, suffixes, word_windows
from .common import table, whole_text


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source`` stands for both repository and owner, the table has no other column for either."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)]
    copied = F.size(F.filter("spans", lambda s: s["copied"])).cast("long").alias("n_copied")
    live = F.size(F.filter("spans", lambda s: ~s["copied"])).cast("long").alias("n_live")
    return found.select("doc_id", *counts, F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), copied, live)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "round", "part", "bins", "bound")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", (F.floor(F.col("posterior") * 1000000.0 + 0.5) / 1000000.0).alias("posterior"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return neighbours.classify(docs, neighbours.learn(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", F.sha2(whole_text(), 256).alias("kept_sha256"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scans, op2_best_fit_packing, op3_quality_rules, op4_suffix_array_dedup, op5_language_id, op6_line_dedup, op7_quality_classifier, op8_benchmark_decontamination, op9_substring_dedup, op10_simhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scans": oracles.SECRETS, "op3_quality_rules": oracles.quality(quality.FUNCTION_WORDS, quality.ITERATIONS), "op4_suffix_array_dedup": oracles.SUFFIXES, "op6_line_dedup": oracles.LINES, "op9_substring_dedup": oracles.WORD_WINDOWS}
