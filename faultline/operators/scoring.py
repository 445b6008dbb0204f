"""Contributions, capped scores and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import classify_score


def contributions(findings: DataFrame) -> DataFrame:
    """Raw and effective weight of each rule of each change.

    Mitigations count in rule order, each at most what is left of the positive
    total; the running sum of those before tells what is left.
    """
    raw = findings.groupBy("change_id", "rule_id").agg(F.sum("weight").alias("raw"), F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))
    change = Window.partitionBy("change_id")
    before = change.orderBy("rule_id").rowsBetween(Window.unboundedPreceding, -1)
    positive = F.sum(F.greatest("raw", F.lit(0.0))).over(change)
    spent = F.coalesce(F.sum(F.least("raw", F.lit(0.0))).over(before), F.lit(0.0))
    left = F.greatest(positive + spent, F.lit(0.0))
    effective = F.when(F.col("raw") < 0, F.greatest(F.col("raw"), -left)).otherwise(F.col("raw"))
    return raw.select("change_id", "rule_id", "raw", "finding_ids", (effective + 0.0).alias("weight"))


def scores(changes: DataFrame, contributed: DataFrame, thresholds: tuple[float, float, float] = (20, 50, 80)) -> DataFrame:
    """Score and class of every change, findings or not."""
    total = contributed.groupBy("change_id").agg(F.sum("weight").alias("score"))
    out = changes.select("change_id").distinct().join(total, "change_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + 0.0)
    return out.withColumn("classification", classify_score(F.col("score"), thresholds))
