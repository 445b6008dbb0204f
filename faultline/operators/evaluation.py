"""Cohort statistics over labelled analyses, per segment.

A segment is one value of (profile, configuration_digest, packs, stratum, split,
scope, value), so cases that were analysed with different settings never share
one. Each case counts in its cohort, its language and, if complete, its change
size. ``segmented`` opens cases that way once; every metric is then one
aggregation over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import CLASSES, LIMITATION_CATEGORIES, TIERS, UNAVAILABLE_REASONS, change_size, limitation_category, ordinal, ratio

SETTINGS = ("profile", "configuration_digest", "packs")
SEGMENT = (*SETTINGS, "stratum", "split", "scope", "value")
#: Evaluated cases from which a segment's comparisons are sufficient.
ENOUGH = 40


def segmented(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per case and segment, with its label. Settings that cases don't tell count as empty."""
    told = {c: F.coalesce(F.col(c), F.lit("")) if c in cases.columns else F.lit("") for c in SETTINGS}
    joined = cases.withColumns(told).join(labels, "case_id")
    scope = lambda name, value: F.struct(F.lit(name).alias("scope"), value.alias("value"))
    size = F.when(F.col("status") == "complete", scope("change-size", change_size(F.col("files"), F.col("lines"))))
    opened = joined.withColumn("s", F.explode(F.array_compact(F.array(scope("cohort", F.lit("all")), scope("language", F.col("language")), size))))
    actual = ordinal(F.col("classification"), CLASSES)
    return opened.select("*", "s.scope", "s.value", actual.alias("actual")).drop("s")


def configuration_digests(cases: DataFrame) -> DataFrame:
    """The distinct configuration digests, as one sorted list."""
    return cases.agg(F.array_sort(F.collect_set("configuration_digest")).alias("digests"))


def evaluated(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'complete' AND resolved IS NOT NULL")


def _dense(rows: DataFrame, names: tuple[str, ...], column: str) -> DataFrame:
    """Every segment with every name of a fixed vocabulary."""
    return rows.select(*SEGMENT).distinct().withColumn(column, F.explode(F.array(*map(F.lit, names))))


def rates(rows: DataFrame) -> DataFrame:
    """Case, analysable, insufficient and evaluated counts."""
    done = (F.col("status") == "complete") & F.col("resolved").isNotNull()
    out = rows.groupBy(*SEGMENT).agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "complete").alias("analyzable"), F.count_if("insufficient").alias("insufficient"), F.count_if(done).alias("evaluated"))
    return out.withColumn("comparison", F.when(F.col("evaluated") >= ENOUGH, "sufficient").otherwise("insufficient"))


def confusion(rows: DataFrame) -> DataFrame:
    """The dense 4 by 4 matrix, resolved tier by class."""
    counts = evaluated(rows).groupBy(*SEGMENT, "resolved", "actual").agg(F.count("*").alias("n"))
    cells = rows.select(*SEGMENT).distinct().withColumn("resolved", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("actual", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return cells.join(counts, [*SEGMENT, "resolved", "actual"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def triage(rows: DataFrame) -> DataFrame:
    """Exact, within one, and the directions of misses."""
    d = F.col("actual") - F.col("resolved")
    return evaluated(rows).groupBy(*SEGMENT).agg(
        F.count("*").alias("n"),
        F.count_if(d == 0).alias("exact"),
        F.count_if(F.abs(d) <= 1).alias("within_one"),
        F.count_if(d == -1).alias("under_one"),
        F.count_if(d <= -2).alias("under_two"),
        F.count_if(d == 1).alias("over_one"),
        F.count_if(d >= 2).alias("over_two"),
    )


def tier_metrics(matrix: DataFrame) -> DataFrame:
    """A10: precision, recall and F1 of each tier; zero denominators give 0."""
    out = None
    for t, name in enumerate(TIERS):
        hit, want, got = (F.sum(F.when(c, F.col("n")).otherwise(0)) for c in ((F.col("resolved") == t) & (F.col("actual") == t), F.col("resolved") == t, F.col("actual") == t))
        one = matrix.groupBy(*SEGMENT).agg(F.lit(name).alias("tier"), want.alias("support"), hit.alias("hit"), got.alias("predicted"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumns({"precision": ratio(F.col("hit"), F.col("predicted")), "recall": ratio(F.col("hit"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.when(both == 0, 1).otherwise(both)))


def macro_f1(matrix: DataFrame) -> DataFrame:
    """Macro F1 (always over four tiers) and combined high-tier recall."""
    tiers = tier_metrics(matrix).groupBy(*SEGMENT).agg((F.sum("f1") / 4).alias("macro_f1"))
    high = F.col("resolved") >= 2
    recall = matrix.groupBy(*SEGMENT).agg(F.sum(F.when(high & (F.col("actual") >= 2), F.col("n")).otherwise(0)).alias("high_hit"), F.sum(F.when(high, F.col("n")).otherwise(0)).alias("high_support"))
    return tiers.join(recall, [*SEGMENT]).withColumn("high_recall", ratio(F.col("high_hit"), F.col("high_support")))


def _kappa(x: Column, y: Column) -> Column:
    """A12 from moments: 1 - E[(x-y)^2] / (E[x^2] + E[y^2] - 2 E[x] E[y]), clamped."""
    n = F.count("*").cast("double")
    off = F.sum((x - y) * (x - y)) / n
    expected = F.sum(x * x) / n + F.sum(y * y) / n - 2 * (F.sum(x) / n) * (F.sum(y) / n)
    return F.when(F.abs(expected) > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - off / F.when(F.abs(expected) > 1e-12, expected))))


def kappa(rows: DataFrame) -> DataFrame:
    """Quadratic weighted kappa of resolved tiers and classes."""
    return evaluated(rows).groupBy(*SEGMENT).agg(_kappa(F.col("resolved"), F.col("actual")).alias("kappa"))


def agreement(rows: DataFrame) -> DataFrame:
    """The two reviewers, where neither lacked context."""
    d = F.abs(F.col("left_tier") - F.col("right_tier"))
    pairs = rows.where("NOT insufficient AND left_tier IS NOT NULL AND right_tier IS NOT NULL")
    return pairs.groupBy(*SEGMENT).agg(F.count("*").alias("pairs"), F.count_if(d == 0).alias("exact"), F.count_if(d <= 1).alias("within_one"), _kappa(F.col("left_tier"), F.col("right_tier")).alias("kappa"))


def spearman(rows: DataFrame) -> DataFrame:
    """Rank correlation of score and resolved tier, null without variance."""
    part = Window.partitionBy(*SEGMENT)
    mean_rank = lambda c: F.rank().over(part.orderBy(c)) + (F.count("*").over(Window.partitionBy(*SEGMENT, c)) - 1) / 2
    ranked = evaluated(rows).select(*SEGMENT, mean_rank("score").alias("x"), mean_rank("resolved").alias("y"))
    n = F.count("*").cast("double")
    cov = F.sum(F.col("x") * F.col("y")) - F.sum("x") * F.sum("y") / n
    spread = (F.sum(F.col("x") * F.col("x")) - F.sum("x") * F.sum("x") / n) * (F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / n)
    value = F.when((n >= 2) & (spread > 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(F.when(spread > 1e-9, spread)))))
    return ranked.groupBy(*SEGMENT).agg(value.alias("spearman"))


def unavailable(rows: DataFrame) -> DataFrame:
    """Dense over the reasons."""
    counts = rows.where("status = 'unavailable'").groupBy(*SEGMENT, "reason").agg(F.count("*").alias("n"))
    return _dense(rows, UNAVAILABLE_REASONS, "reason").join(counts, [*SEGMENT, "reason"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def limitation_prevalence(rows: DataFrame, limitations: DataFrame) -> DataFrame:
    """Complete cases with each category, dense over the categories."""
    kinds = limitations.select("case_id", limitation_category(F.col("limitation")).alias("category")).distinct()
    counts = rows.where("status = 'complete'").select(*SEGMENT, "case_id").join(kinds, "case_id").groupBy(*SEGMENT, "category").agg(F.count("*").alias("n"))
    return _dense(rows, LIMITATION_CATEGORIES, "category").join(counts, [*SEGMENT, "category"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def finding_prevalence(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases and findings of each rule, counted per case first."""
    each = findings.groupBy("case_id", "rule_id").agg(F.count("*").alias("k"))
    return rows.where("status = 'complete'").select(*SEGMENT, "case_id").join(each, "case_id").groupBy(*SEGMENT, "rule_id").agg(F.count("*").alias("cases"), F.sum("k").alias("findings"))


def cooccurrence(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases that have both rules of a pair.

    The pairs of a case come from its own sorted rule set (at most 32 rules).
    """
    sets = findings.groupBy("case_id").agg(F.array_sort(F.collect_set("rule_id")).alias("r"))
    pairs = F.flatten(F.transform("r", lambda a, i: F.transform(F.slice(F.col("r"), i + 2, F.size("r")), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    opened = sets.select("case_id", F.explode(pairs).alias("p"))
    return rows.where("status = 'complete'").select(*SEGMENT, "case_id").join(opened, "case_id").groupBy(*SEGMENT, F.col("p.left").alias("left_rule"), F.col("p.right").alias("right_rule")).agg(F.count("*").alias("cases"))


def evaluate(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """One wide row per segment."""
    rows = segmented(cases, labels)
    out = rates(rows)
    for more in (triage(rows).drop("n"), kappa(rows), spearman(rows), macro_f1(confusion(rows)), agreement(rows).select(*SEGMENT, "pairs", F.col("exact").alias("pairs_exact"), F.col("within_one").alias("pairs_within_one"), F.col("kappa").alias("pairs_kappa"))):
        out = out.join(more, [*SEGMENT], "left")
    return out
