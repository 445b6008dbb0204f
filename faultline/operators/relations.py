"""Test relationships and export comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import TEST_MODULE, test_key


def test_relationships(modules: DataFrame, language: str = "typescript") -> DataFrame:
    """source_path and its sorted test_paths, empty where none is."""
    keyed = modules.select("path", test_key("path", language).alias("key"), F.col("path").rlike(TEST_MODULE[language]).alias("is_test"))
    tests = keyed.where("is_test").groupBy("key").agg(F.array_sort(F.collect_list("path")).alias("test_paths"))
    sources = keyed.where("NOT is_test").select(F.col("path").alias("source_path"), "key")
    return sources.join(tests, "key", "left").select("source_path", F.coalesce("test_paths", F.array().cast("array<string>")).alias("test_paths"))


def export_changes(exports: DataFrame) -> DataFrame:
    """Added, removed and modified names of each changed path.

    Several signatures of a name on one side count as one sorted set.
    """
    key = ["change_id", "path", "name"]
    side = lambda s: exports.where(F.col("side") == s).groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("signature")), "\n").alias(s))
    both = side("base").join(side("head"), key, "full_outer")
    change = F.when(F.col("base").isNull(), "added").when(F.col("head").isNull(), "removed").when(F.col("base") != F.col("head"), "modified")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")
