"""Violation queries: each returns check, key; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import utf16_length, valid_path
from .coverage import eligible

if TYPE_CHECKING:
    from .rules import Facts


def _rows(df: DataFrame, check: str, key: str) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("key"))


def _repeated(df: DataFrame, check: str, *keys: str) -> DataFrame:
    counted = df.groupBy(*keys).count().where("count > 1")
    return counted.select(F.lit(check).alias("check"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"))


def corpus(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Integrity of an evaluation corpus."""
    groups = cases.groupBy("duplicate_group").agg(F.count_distinct("repository_id").alias("r"), F.count_distinct("split").alias("s")).where("r > 1 OR s > 1")
    repos = cases.groupBy("repository_id").agg(
        F.count_distinct("split").alias("splits"),
        F.bool_or(F.col("split") == "unseen-repository").alias("unseen"),
        F.max(F.when(F.col("split") == "development", F.col("sequence_no"))).alias("last_development"),
        F.min(F.when(F.col("split") == "forward-time", F.col("sequence_no"))).alias("first_forward"),
    )
    parts = _sizes(cases) + [
        _repeated(cases, "duplicate-case", "case_id"),
        _repeated(cases, "duplicate-sequence", "repository_id", "sequence_no"),
        _rows(groups, "duplicate-group-crosses", "duplicate_group"),
        _rows(repos.where("unseen AND splits > 1"), "unseen-repository-seen", "repository_id"),
        _rows(repos.where("first_forward <= last_development"), "forward-before-development", "repository_id"),
        _repeated(labels, "duplicate-label", "case_id"),
        _rows(labels.join(cases, "case_id", "left_anti"), "label-without-case", "case_id"),
        _rows(cases.join(labels, "case_id", "left_anti"), "case-without-label", "case_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _sizes(cases: DataFrame) -> list[DataFrame]:
    """V9: revision pairs and the bounds of a corpus, by the columns that it has."""
    have = set(cases.columns)
    parts = [_rows(cases.agg(F.count("*").alias("n")).where(F.col("n") > MAX_CASES), "too-many-cases", "n")]
    if {"base", "head"} <= have:
        parts.append(_repeated(cases, "duplicate-revisions", "repository_id", "base", "head"))
    return parts


def labels(rows: DataFrame) -> DataFrame:
    """V8: resolution rules of label records (tiers as ordinals); with reviewers, those of adjudication too."""
    d = F.abs(F.col("left_tier") - F.col("right_tier"))
    parts = _reviewers(rows, d) if "left_reviewer" in rows.columns else []
    parts += [
        _rows(rows.where("insufficient AND resolved IS NOT NULL"), "insufficient-but-resolved", "case_id"),
        _rows(rows.where("NOT insufficient AND resolved IS NULL"), "unresolved", "case_id"),
        _rows(rows.where((d == 0) & (F.col("resolved") != F.col("left_tier"))), "matching-tiers-changed", "case_id"),
        _rows(rows.where((d == 1) & ~F.col("resolved").isin(F.col("left_tier"), F.col("right_tier"))), "one-tier-disagreement-elsewhere", "case_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _reviewers(rows: DataFrame, distance: Column) -> list[DataFrame]:
    far, judge = ~F.col("insufficient") & (distance > 1), F.col("adjudicator")
    return [
        _rows(rows.where("left_reviewer = right_reviewer"), "reviewers-not-distinct", "case_id"),
        _rows(rows.where(F.col("insufficient") & judge.isNotNull()), "insufficient-but-adjudicated", "case_id"),
        _rows(rows.where(far & judge.isNull()), "adjudicator-missing", "case_id"),
        _rows(rows.where(far & judge.isin(F.col("left_reviewer"), F.col("right_reviewer"))), "adjudicator-not-distinct", "case_id"),
        _rows(rows.where(far & judge.isNotNull() & ~F.col("resolved").eqNullSafe(F.col("adjudicator_tier"))), "resolved-differs-from-adjudicator", "case_id"),
        _rows(rows.where(~F.col("insufficient") & (distance <= 1) & judge.isNotNull()), "adjudication-not-needed", "case_id"),
    ]


# Vocabularies and bounds of evaluation cases.
VOCABULARY = {
    "language": ("typescript", "python"),
    "profile": ("default-scoring", "repository-policy"),
    "stratum": ("representative", "signal-enriched"),
    "split": ("development", "forward-time", "unseen-repository"),
    "reason": ("revision-unavailable", "invalid-result", "resource-limit", "operational-error", "other"),
}
PACKS = ("security-sensitive", "strict-review")
IDENTIFIER, OBJECT, DIGEST = r"^[a-z0-9][a-z0-9._-]{0,127}\z", r"^[0-9a-f]{40}\z", r"^[0-9a-f]{64}\z"
MAX_CASES, MAX_RULES, MAX_SEGMENTS, MAX_FILES, MAX_FINDINGS, MAX_LIMITATIONS, MAX_TEXT = 10_000, 32, 1_000, 10_000, 10_000, 1_000, 4_096


def cases(rows: DataFrame, findings: DataFrame | None = None, limitations: DataFrame | None = None) -> DataFrame:
    """V7: fields of evaluation cases and the bounds of each.

    Only the columns that the table has are looked at; a case's result_base and
    result_head are what its own result says.
    """
    have = set(rows.columns)
    good = {c: F.col(c).isin(*names) for c, names in VOCABULARY.items() if c in have}
    good |= {c: F.col(c).rlike(p) for c, p in (("repository_id", IDENTIFIER), ("base", OBJECT), ("head", OBJECT), ("configuration_digest", DIGEST)) if c in have}
    parts = [_rows(rows.where(~F.coalesce(ok, F.lit(False)) & (F.lit(c != "reason") | (F.col("status") == "unavailable"))), f"invalid-{c.replace('_', '-')}", "case_id") for c, ok in good.items()]
    if "packs" in have:
        packs = F.filter(F.split("packs", ","), lambda p: p != "")
        parts.append(_rows(rows.where(F.exists(packs, lambda p: ~p.isin(*PACKS)) | (F.size(packs) != F.size(F.array_distinct(packs)))), "invalid-packs", "case_id"))
        parts.append(_rows(rows.where((F.col("profile") == "default-scoring") & (F.size(packs) > 0)), "packs-with-default-scoring", "case_id"))
    if "result_base" in have:
        parts.append(_rows(rows.where("status = 'complete' AND (result_base <> base OR result_head <> head)"), "revisions-differ", "case_id"))
    if "files" in have:
        parts.append(_rows(rows.where(F.col("files") > MAX_FILES), "too-many-files", "case_id"))
    for table, check, most in ((findings, "too-many-findings", MAX_FINDINGS), (limitations, "too-many-limitations", MAX_LIMITATIONS)):
        if table is not None:
            parts.append(_rows(table.groupBy("case_id").count().where(F.col("count") > most), check, "case_id"))
    if findings is not None:
        parts.append(_rows(findings.where(~F.col("rule_id").rlike(IDENTIFIER)), "invalid-rule-id", "case_id"))
    if limitations is not None:
        parts.append(_rows(limitations.where(F.length("limitation") > MAX_TEXT), "limitation-too-long", "case_id"))
    return reduce(DataFrame.unionByName, parts)


def facts(given: Facts) -> DataFrame:
    """Evidence that rules may rely on: valid fields, unique keys, and exactly the changed paths.

    Limits and keys hold within one change.
    """
    text = lambda c, most=1_000: utf16_length(F.col(c)).between(1, most)
    files, parts = given.files.select("change_id", "path"), []
    crowded = lambda df, what: _rows(df.groupBy("change_id").count().where("count > 100000"), f"{what}-limit", "change_id")
    if given.coverage is not None:
        c, want = given.coverage, eligible(given.files).select("change_id", "path")
        pair = lambda found, hit: F.col(found).isNotNull() & F.col(hit).isNotNull() & (F.col(hit) >= 0) & (F.col(hit) <= F.col(found))
        none = lambda found, hit: F.col(found).isNull() & F.col(hit).isNull()
        whole = none("lines_found", "lines_hit") | pair("lines_found", "lines_hit")
        base = ~F.col("has_baseline") | none("baseline_found", "baseline_hit") | pair("baseline_found", "baseline_hit")
        counted = F.col("changed_count").isNotNull() & (F.col("changed_count") >= 0)
        absent, measured = none("changed_found", "changed_hit") & none("lines_found", "lines_hit"), pair("changed_found", "changed_hit") & (F.col("changed_found") <= F.col("changed_count")) & pair("lines_found", "lines_hit")
        changed = ~F.col("has_changed") | counted & (absent | measured)
        parts += [_rows(c.where(~(valid_path(F.col("path")) & whole & base & changed)), "coverage-invalid", "path"), crowded(c, "coverage")]
        parts += [p.withColumn("check", F.concat(F.lit("coverage-"), "check")) for p in [completeness(want, c.select("change_id", "path"))]]
    if given.exports is not None:
        e = given.exports
        ok = text("path") & text("name") & F.col("change").isin("added", "modified", "removed")
        parts += [_rows(e.where(~F.coalesce(ok, F.lit(False))), "export-invalid", "path"), _repeated(e, "export-duplicate", "change_id", "path", "name", "change"), crowded(e, "export")]
    if given.tests is not None:
        t = given.tests
        ok = text("source_path") & (F.size("test_paths") <= 1_000) & F.forall("test_paths", lambda p: utf16_length(p).between(1, 1_000))
        parts += [_rows(t.where(~F.coalesce(ok, F.lit(False))), "test-invalid", "source_path"), _repeated(t, "test-duplicate-source", "source_path")]
        parts.append(_rows(t.where(F.size("test_paths") != F.size(F.array_distinct("test_paths"))), "test-duplicate-path", "source_path"))
    if given.owners is not None:
        o = given.owners
        ok = text("path") & (F.size("owners") <= 100) & F.forall("owners", lambda x: utf16_length(x).between(1, 200))
        parts += [_rows(o.where(~F.coalesce(ok, F.lit(False))), "owner-invalid", "path"), _rows(o.where(F.size("owners") != F.size(F.array_distinct("owners"))), "owner-duplicate", "path"), crowded(o, "owner")]
        parts += [p.withColumn("check", F.concat(F.lit("owner-"), "check")) for p in [completeness(files.distinct(), o.select("change_id", "path"))]]
    bad = [k for k, ps in given.areas.items() if not 1 <= len(k) <= 200 or not 1 <= len(ps) <= 100 or any(not 1 <= len(p) <= 1_000 for p in ps)]
    if bad:
        parts.append(given.files.sparkSession.createDataFrame([("area-invalid", k) for k in bad], "check string, key string"))
    return reduce(DataFrame.unionByName, parts, given.files.sparkSession.createDataFrame([], "check string, key string"))


def result_integrity(findings: DataFrame, contributions: DataFrame, scores: DataFrame) -> DataFrame:
    """Findings, contributions and scores account for each other."""
    listed = contributions.select("change_id", "rule_id", F.explode("finding_ids").alias("finding_id"))
    own = findings.select("change_id", "rule_id", "finding_id")
    key = ["change_id", "rule_id", "finding_id"]
    total = contributions.groupBy("change_id").agg(F.sum("weight").alias("total"))
    off = scores.join(total, "change_id", "left").where(F.abs(F.col("score") - F.coalesce("total", F.lit(0.0))) > 1e-9)
    parts = [
        _repeated(findings, "duplicate-finding", "change_id", "finding_id"),
        _rows(own.join(listed, key, "left_anti"), "finding-without-contribution", "finding_id"),
        _rows(listed.join(own, key, "left_anti"), "contribution-without-finding", "finding_id"),
        _repeated(listed, "finding-counted-twice", "change_id", "finding_id"),
        _rows(off, "score-differs", "change_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def completeness(expected: DataFrame, given: DataFrame) -> DataFrame:
    """(change_id, path) sets must be equal."""
    key = ["change_id", "path"]
    return reduce(DataFrame.unionByName, [_rows(expected.join(given, key, "left_anti"), "missing", "path"), _rows(given.join(expected, key, "left_anti"), "unexpected", "path"), _repeated(given, "duplicate", *key)])


def blast_radius(nodes: DataFrame, edges: DataFrame, totals: DataFrame) -> DataFrame:
    """A blast radius is consistent: unique nodes, edges between them, counts that cover what is shown."""
    inside = nodes.select("change_id", F.col("path").alias("p"))
    ends = edges.select("change_id", F.explode(F.array("src", "dst")).alias("p"))
    shown = nodes.groupBy("change_id").agg(F.count("*").alias("n"), F.count_if(F.col("distance") == 0).alias("seeds"))
    drawn = edges.groupBy("change_id").agg(F.count("*").alias("e"))
    zero = F.lit(0)
    whole = totals.join(shown, "change_id", "left").join(drawn, "change_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("n", "seeds", "e")})
    absent = totals.select("change_id", F.explode("unindexed").alias("p"))
    parts = [
        _repeated(nodes, "duplicate-node", "change_id", "path"),
        _repeated(edges, "duplicate-edge", "change_id", "src", "dst"),
        _rows(ends.join(inside, ["change_id", "p"], "left_anti"), "edge-without-node", "p"),
        _rows(absent.join(inside, ["change_id", "p"], "left_semi"), "unindexed-but-shown", "p"),
        _rows(whole.where("n > graph_nodes OR e > graph_edges"), "more-than-the-graph", "change_id"),
        _rows(whole.where("changed < seeds + size(unindexed)"), "more-seeds-than-changes", "change_id"),
    ]
    return reduce(DataFrame.unionByName, parts)
