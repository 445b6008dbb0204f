"""JSON inputs with explicit schemas: CI events and evaluation corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import TIERS, ordinal

EVENTS = """number long, before string, after string,
  pull_request struct<base: struct<sha: string, repo: struct<full_name: string>>, head: struct<sha: string, repo: struct<full_name: string>>>"""
_LABEL = "struct<reviewer_id: string, tier: string, insufficient: boolean, reason_codes: array<string>>"
CORPUS = f"""id string, repository_id string, duplicate_group string, sequence long, language string, profile string, policy_packs array<string>,
  sampling_stratum string, split string, configuration_digest string, base string, head string, status string, reason string,
  result struct<score: double, classification: string, changed_files: array<struct<additions: long, deletions: long>>, findings: array<struct<rule_id: string>>, limitations: array<string>>,
  labels array<{_LABEL}>, resolved_tier string"""


def events(spark: SparkSession, path: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """(base, head, number, same_repository) of pull-request and push events, and the files that are neither."""
    raw = spark.read.schema(EVENTS + ", _corrupt_record string").option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    pull = F.col("pull_request").isNotNull()
    name = lambda side: F.col(f"pull_request.{side}.repo.full_name")
    out = raw.select(
        "file",
        F.when(pull, F.col("pull_request.base.sha")).otherwise(F.col("before")).alias("base"),
        F.when(pull, F.col("pull_request.head.sha")).otherwise(F.col("after")).alias("head"),
        F.when(pull, F.col("number")).alias("number"),
        F.coalesce(pull & (name("base") == repository) & (name("head") == repository), F.lit(False)).alias("same_repository"),
        (pull & (name("base").isNull() | name("head").isNull() | ~F.coalesce(F.col("number") >= 1, F.lit(False)))).alias("broken"),
    )
    line = lambda c: F.coalesce((F.length(c) > 0) & ~F.col(c).rlike(r"[\r\n]"), F.lit(False))
    good = line("base") & line("head") & ~F.col("broken")
    return out.where(good).drop("broken"), out.where(~good).select("file")


def corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cases, labels, findings and limitations of an evaluation corpus (one JSON object a line)."""
    raw = spark.read.schema(CORPUS).json(path)
    total = F.aggregate("result.changed_files", F.lit(0).cast("long"), lambda s, f: s + f["additions"] + f["deletions"])
    cases = raw.select(
        F.col("id").alias("case_id"), "repository_id", "duplicate_group", F.col("sequence").alias("sequence_no"), "language", "profile", F.array_join(F.array_sort("policy_packs"), ",").alias("packs"),
        "configuration_digest", "base", "head", F.col("sampling_stratum").alias("stratum"), "split", "status", "reason", "result.score", "result.classification",
        F.when(F.col("result").isNotNull(), F.size("result.changed_files").cast("long")).alias("files"), total.alias("lines"),
    )
    label = lambda k: F.try_element_at("labels", F.lit(k))
    lacking = F.coalesce(label(1)["insufficient"], F.lit(False)) | F.coalesce(label(2)["insufficient"], F.lit(False))
    labels = raw.select(F.col("id").alias("case_id"), ordinal(label(1)["tier"], TIERS).alias("left_tier"), ordinal(label(2)["tier"], TIERS).alias("right_tier"), ordinal(F.col("resolved_tier"), TIERS).alias("resolved"), lacking.alias("insufficient"))
    findings = raw.select(F.col("id").alias("case_id"), F.explode("result.findings.rule_id").alias("rule_id"))
    limitations = raw.select(F.col("id").alias("case_id"), F.explode("result.limitations").alias("limitation"))
    return cases, labels, findings, limitations
