"""The risk rules as DataFrames, and the engine that numbers their matches.

A rule maps facts to matches: change_id, key (the order of its matches within a
change), severity, kind, title, summary, paths (array), sources (array, the
evidence's own paths) and data (JSON text). The rules that only look at a
change's files are columns over one shared aggregation of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_kind
from ..functions.paths import area
from ..plans.cut import cut
from . import coverage, graph, ownership


@dataclass(frozen=True)
class Facts:
    """What rules look at; absent evidence is None and keeps its rule silent.

    files: change_id, path, status, additions, deletions, categories.
    graph_nodes / graph_edges: path / src, dst. tests: source_path, test_paths.
    owners: change_id, path, owners. exports: change_id, path, name, change.
    coverage: as ``coverage.concerns`` reads it.
    """

    files: DataFrame
    graph_nodes: DataFrame | None = None
    graph_edges: DataFrame | None = None
    tests: DataFrame | None = None
    owners: DataFrame | None = None
    exports: DataFrame | None = None
    coverage: DataFrame | None = None
    areas: Mapping[str, list[str]] = field(default_factory=dict)


Options = Mapping[str, float]


@dataclass(frozen=True)
class Rule:
    """A rule reads the facts (``evaluate``) or, as ``shaped``, a row of ``shape``:
    its condition and the columns of its match.
    """

    id: str
    weight: float
    evaluate: Callable[[Facts, Options], DataFrame | None] | None = None
    explanation: str = ""
    remediation: str | None = None
    shaped: Callable[[Options], tuple[Column, list[Column]]] | None = None


@dataclass(frozen=True)
class Setting:
    enabled: bool = True
    weight: float | None = None
    options: Options = field(default_factory=dict)


def number(options: Options, name: str, default: float, low: float, high: float, whole: bool = False) -> float:
    """An option within its inclusive range."""
    value = options.get(name, default)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high or (whole and value != int(value)):
        raise ValueError(f"option {name} must be {'an integer' if whole else 'a number'} from {low} to {high}")
    return value


def integer(options: Options, name: str, default: int, low: int, high: int) -> int:
    return int(number(options, name, default, low, high, whole=True))


def sorted_paths(where: Column | None = None) -> Column:
    path = F.col("path") if where is None else F.when(where, F.col("path"))
    return F.array_sort(F.collect_set(path))


def has(category: str) -> Column:
    return F.array_contains("categories", category)


def shape(files: DataFrame) -> DataFrame:
    """A1, A2 and what the category rules need, one row per change."""
    sets = {"dependency": has("dependency"), "infrastructure": has("infrastructure") | has("ci"), "migration": has("migration")}
    return files.groupBy("change_id").agg(
        F.count("*").alias("files"),
        F.sum(F.col("additions") + F.col("deletions")).alias("lines"),
        F.array_sort(F.collect_set(area("path"))).alias("areas"),
        sorted_paths().alias("paths"),
        *[sorted_paths(c).alias(name) for name, c in sets.items()],
    )


MATCH = ("key", "severity", "kind", "title", "summary", "paths", "sources", "data")


def _columns(key: Column, severity: Column | str, kind: str, title: Column | str, summary: Column, paths: Column, data: Column, sources: Column | None = None) -> list[Column]:
    made = (key.cast("string"), F.lit(severity) if isinstance(severity, str) else severity, F.lit(kind), F.lit(title) if isinstance(title, str) else title, summary, paths, paths if sources is None else sources, data)
    return [c.alias(name) for c, name in zip(made, MATCH, strict=True)]


def said(count: Column, text: str) -> Column:
    return F.concat(count.cast("string"), F.lit(text))


def _category(rule: str, column: str, categories: tuple[str, ...], severity: str, title: str):
    def shaped(options: Options) -> tuple[Column, list[Column]]:
        n = F.size(column)
        data = F.to_json(F.struct(F.array(*map(F.lit, categories)).alias("categories"), n.alias("fileCount")))
        return n > 0, _columns(F.lit(""), severity, "file-category", title, said(n, f" changed file(s) matched {rule}"), F.col(column), data)

    return shaped


def large_change(options: Options) -> tuple[Column, list[Column]]:
    """R5."""
    files, lines = integer(options, "maxFiles", 20, 1, 100_000), integer(options, "maxLines", 500, 1, 10_000_000)
    severity = F.when((F.col("files") > 2 * files) | (F.col("lines") > 2 * lines), "high").otherwise("medium")
    data = F.to_json(F.struct(F.col("files").alias("fileCount"), F.col("lines").alias("lineCount"), F.lit(files).alias("maxFiles"), F.lit(lines).alias("maxLines")))
    summary = F.concat(F.col("files").cast("string"), F.lit(" files and "), F.col("lines").cast("string"), F.lit(" changed lines exceed configured size limits"))
    return (F.col("files") > files) | (F.col("lines") > lines), _columns(F.lit(""), severity, "change-shape", "Large change", summary, F.col("paths"), data)


def multi_area(options: Options) -> tuple[Column, list[Column]]:
    """R9."""
    least = integer(options, "minAreas", 3, 2, 1_000)
    n = F.size("areas")
    summary = F.concat(F.lit("Changes span "), n.cast("string"), F.lit(" top-level areas"))
    return n >= least, _columns(F.lit(""), "medium", "change-shape", "Multi-area change", summary, F.col("paths"), F.to_json(F.struct("areas", F.lit(least).alias("minAreas"))))


def sensitive_path(facts: Facts, options: Options) -> DataFrame | None:
    """R11."""
    if not facts.areas:
        return None
    rows = ownership.sensitive(facts.files, dict(facts.areas)).groupBy("change_id", "area").agg(sorted_paths().alias("paths"))
    patterns = F.create_map(*[x for area_id, some in sorted(facts.areas.items()) for x in (F.lit(area_id), F.array(*map(F.lit, sorted(some))))])
    summary = F.concat(F.size("paths").cast("string"), F.lit(" changed file(s) matched sensitive area "), "area")
    data = F.to_json(F.struct(F.col("area").alias("areaId"), patterns[F.col("area")].alias("patterns")))
    return rows.select("change_id", *_columns(F.col("area"), "high", "path-policy", F.concat(F.lit("Sensitive area changed: "), "area"), summary, F.col("paths"), data))


def high_fan_in(facts: Facts, options: Options) -> DataFrame | None:
    """R2: searches start from the changed nodes with enough fan-in only."""
    if facts.graph_nodes is None or facts.graph_edges is None:
        return None
    least, depth = integer(options, "minFanIn", 5, 1, 100_000), integer(options, "maxTraversalDepth", 20, 1, 100)
    edges = cut(facts.graph_edges)
    hot = cut(graph.metrics(facts.graph_nodes, edges).where(F.col("fan_in") >= least).join(facts.files.select("path").distinct(), "path", "left_semi"))
    reached, stopped = graph.transitive_dependents(edges, hot.select("path"), depth)
    found = F.collect_list(F.struct("distance", "dependent"))
    lists = reached.groupBy(F.col("seed").alias("path")).agg(F.array_sort(found).alias("dependents"))
    cuts = stopped.select(F.col("seed").alias("path"), F.lit(True).alias("truncated"))
    modules = cut(hot.join(lists, "path", "left").join(cuts, "path", "left").withColumn("dependents", F.coalesce("dependents", F.array().cast(lists.schema["dependents"].dataType))))
    # what a module reaches is worked out once, whatever number of changes touch it
    direct = F.transform(F.filter("dependents", lambda d: d["distance"] == 1), lambda d: d["dependent"])
    transitive = F.transform("dependents", lambda d: F.struct(d["dependent"].alias("path"), d["distance"].alias("distance")))
    fan_in = F.col("fan_in")
    data = F.to_json(F.struct("path", fan_in.alias("fanIn"), F.col("fan_out").alias("fanOut"), F.lit(least).alias("minFanIn"), direct.alias("directDependents"), transitive.alias("transitiveDependents"), F.lit(depth).alias("maxTraversalDepth"), F.coalesce("truncated", F.lit(False)).alias("truncated")))
    paths = F.array_sort(F.array_distinct(F.concat(F.array("path"), F.transform("dependents", lambda d: d["dependent"]))))
    severity = F.when(F.size("dependents") >= 2 * least, "high").otherwise("medium")
    summary = F.concat("path", F.lit(" has "), fan_in.cast("string"), F.lit(" direct dependent(s)"))
    matches = modules.select("path", *_columns(F.col("path"), severity, "dependency-impact", F.concat(F.lit("High-fan-in module changed: "), "path"), summary, paths, data, F.array("path")))
    return facts.files.select("change_id", "path").join(matches, "path").drop("path")


def _sources(files: DataFrame) -> DataFrame:
    return files.where(is_kind("source", "test")).select("change_id", F.col("path").alias("source_path"))


def _related(facts: Facts, test: Column) -> DataFrame:
    """change_id, source_path, test_paths, touched: changed sources with their tests, and the change's own test files.

    A change's files are gathered once, then its sources join their tests.
    """
    source = is_kind("source", "test")
    gathered = facts.files.where(source | test).groupBy("change_id").agg(F.collect_set(F.when(source, F.col("path"))).alias("sources"), F.collect_set(F.when(test, F.col("path"))).alias("touched"))
    each = gathered.select("change_id", "touched", F.explode("sources").alias("source_path"))
    return each.join(facts.tests, "source_path")


def missing_tests(facts: Facts, options: Options) -> DataFrame | None:
    """Deleted sources count as changed, deleted tests don't."""
    if facts.tests is None:
        return None
    rows = _related(facts, has("test") & (F.col("status") != "deleted")).where(~F.arrays_overlap("test_paths", "touched"))
    tests = F.array_sort("test_paths")
    paths = F.array_sort(F.array_distinct(F.concat(F.array("source_path"), "test_paths")))
    data = F.to_json(F.struct(F.col("source_path").alias("sourcePath"), tests.alias("relatedTests"), F.array().cast("array<string>").alias("changedRelatedTests")))
    title, summary = (F.concat(F.lit(x), "source_path") for x in ("No related test changed: ", "No related test changed for "))
    return rows.select("change_id", *_columns(F.col("source_path"), "medium", "test-relationship", title, summary, paths, data))


def tests_added(facts: Facts, options: Options) -> DataFrame | None:
    """R12."""
    if facts.tests is None:
        return None
    pairs = _related(facts, has("test") & (F.col("status") == "added")).withColumn("new", F.array_intersect("test_paths", "touched")).where(F.size("new") > 0)
    rows = pairs.groupBy("change_id").agg(F.array_sort(F.collect_set("source_path")).alias("sources_"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("new")))).alias("tests_"))
    data = F.to_json(F.struct(F.col("sources_").alias("sourcePaths"), F.col("tests_").alias("testPaths")))
    return rows.select("change_id", *_columns(F.lit(""), "info", "test-relationship", "Related tests added", said(F.size("tests_"), " related test file(s) added"), F.array_sort(F.array_union("sources_", "tests_")), data))


def missing_owner(facts: Facts, options: Options) -> DataFrame | None:
    """R7."""
    if facts.owners is None:
        return None
    rows = facts.owners.where(F.size("owners") == 0).groupBy("change_id").agg(sorted_paths().alias("paths"))
    n = F.size("paths")
    data = F.to_json(F.struct(n.alias("fileCount"), F.col("paths").alias("unownedPaths")))
    return rows.select("change_id", *_columns(F.lit(""), "medium", "ownership", "Changed files lack CODEOWNERS", said(n, " changed file(s) have no matching CODEOWNERS rule"), F.col("paths"), data))


def insufficient_coverage(facts: Facts, options: Options) -> DataFrame | None:
    """R4."""
    if facts.coverage is None:
        return None
    names = ("minLinePercent", "minChangedLinePercent", "maxLinePercentDrop")
    limits = [number(options, name, default, 0, 100) for name, default in zip(names, (80, 80, 0), strict=True)]
    found = coverage.concerns(facts.coverage, *limits)
    concern = F.struct(
        "path", F.col("lines_found").alias("linesFound"), F.col("lines_hit").alias("linesHit"), F.col("baseline_found").alias("baselineLinesFound"), F.col("baseline_hit").alias("baselineLinesHit"),
        F.col("changed_count").alias("changedLineCount"), F.col("changed_found").alias("changedLinesFound"), F.col("changed_hit").alias("changedLinesHit"),
        F.col("line_percent").alias("linePercent"), F.col("baseline_percent").alias("baselineLinePercent"), F.col("delta").alias("linePercentDelta"), F.col("changed_percent").alias("changedLinePercent"),
        F.col("reasons")[0].alias("reason"), "reasons",
    )
    rows = found.groupBy("change_id").agg(sorted_paths().alias("paths"), F.array_sort(F.collect_list(concern)).alias("files"))
    data = F.to_json(F.struct(*[F.lit(v).alias(n) for n, v in zip(names, limits, strict=True)], F.col("files").alias("paths")), {"ignoreNullFields": "false"})
    summary = said(F.size("files"), " changed source file(s) have insufficient supplied line coverage")
    return rows.select("change_id", *_columns(F.lit(""), "medium", "coverage", "Changed source has insufficient supplied coverage", summary, F.col("paths"), data))


def public_export(facts: Facts, options: Options) -> DataFrame | None:
    """R10."""
    if facts.exports is None:
        return None
    change = F.struct("path", F.col("name").alias("exportName"), "change")
    rows = facts.exports.groupBy("change_id").agg(sorted_paths().alias("paths"), F.bool_or(F.col("change") != "added").alias("breaking"), F.array_sort(F.collect_list(change)).alias("changes"))
    summary = said(F.size("changes"), " public export change(s) detected")
    return rows.select("change_id", *_columns(F.lit(""), F.when(F.col("breaking"), "high").otherwise("medium"), "public-api", "Public exports changed", summary, F.col("paths"), F.to_json(F.struct("changes"))))


# Weights, titles (above), explanations and remediations of the rules.
DEFAULT_RULES = (
    Rule(
        "dependency-manifest", 15, shaped=_category("dependency-manifest", "dependency", ("dependency",), "medium", "Dependency files changed"),
        explanation="The change modifies a dependency manifest or lockfile.",
        remediation="Review dependency intent, provenance, version changes, and generated lockfile differences.",
    ),
    Rule(
        "high-fan-in", 25, high_fan_in,
        explanation="A changed module has at least the configured number of direct dependents.",
        remediation="Review compatibility for direct and transitive dependents and target tests at the reported blast radius.",
    ),
    Rule(
        "insufficient-coverage", 20, insufficient_coverage,
        explanation="Complete supplied coverage evidence reports missing, unmeasurable, below-threshold, or regressed whole-file or changed-line coverage for changed source files.",
        remediation="Add or update tests, regenerate the LCOV artifact for the analyzed head, or document why the configured threshold is not appropriate.",
    ),
    Rule(
        "infrastructure", 25, shaped=_category("infrastructure", "infrastructure", ("infrastructure", "ci"), "high", "Infrastructure or CI changed"),
        explanation="The change modifies infrastructure or continuous-delivery configuration.",
        remediation="Require an infrastructure-aware review and verify deployment and rollback plans.",
    ),
    Rule(
        "large-change", 20, shaped=large_change,
        explanation="The change exceeds the configured file-count or changed-line threshold.",
        remediation="Split unrelated work or document why the change must be reviewed as one unit.",
    ),
    Rule(
        "migration", 25, shaped=_category("migration", "migration", ("migration",), "high", "Migration changed"),
        explanation="The change modifies a path classified as a migration.",
        remediation="Document rollout, compatibility, backup, and rollback behavior.",
    ),
    Rule(
        "missing-owner", 15, missing_owner,
        explanation="Complete CODEOWNERS evidence is available, but one or more changed paths have no matching owner rule.",
        remediation="Add a matching CODEOWNERS rule or document who is responsible for reviewing these paths.",
    ),
    Rule(
        "missing-related-tests", 20, missing_tests,
        explanation="A changed source file has explicit test-relationship evidence but none of those tests changed.",
        remediation="Add or update a related test, or document why existing coverage is sufficient for this change.",
    ),
    Rule(
        "multi-area-change", 15, shaped=multi_area,
        explanation="The change crosses the configured number of top-level repository areas.",
        remediation="Confirm the cross-area coupling is intentional and assign reviewers for each area.",
    ),
    Rule(
        "public-export", 25, public_export,
        explanation="The supplied TypeScript public-surface comparison reports added, modified, or removed exports.",
        remediation="Review consumer compatibility and update release notes, migration guidance, or versioning as required.",
    ),
    Rule(
        "sensitive-path", 25, sensitive_path,
        explanation="One or more changed paths match a configured sensitive-area pattern.",
        remediation="Apply the review and test policy required for this sensitive area.",
    ),
    Rule(
        "tests-added", -10, tests_added,
        explanation="New test files are explicitly related to source files changed in the same analysis.",
        remediation="Review that the new tests exercise the behavior and failure modes introduced by the source changes.",
    ),
)


def _whole(found: DataFrame) -> DataFrame:
    """Matches of a rule of one's own, which may leave out a summary and the evidence's paths."""
    spare = {"summary": F.col("title"), "sources": F.col("paths")}
    return found.select("change_id", *[F.col(c) if c in found.columns else spare[c].alias(c) for c in MATCH])


def _of_shape(files: DataFrame, chosen: list[tuple[Rule, float, Options]]) -> DataFrame:
    """Matches of all rules that look at a change's files, from one aggregation.

    A row is opened into the rules that it meets first, so that columns which
    nobody reads are not made.
    """
    made = {rule.id: (weight, *rule.shaped(options)) for rule, weight, options in chosen}
    met = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, (_, condition, _) in made.items()]))
    rows = shape(files).withColumn("rule_id", F.explode(met))

    def of_rule(values: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("rule_id") == name, value) for name, value in values.items()])

    weight = of_rule({name: F.lit(w) for name, (w, *_) in made.items()}).alias("weight")
    return rows.select("rule_id", weight, "change_id", *[of_rule({name: columns[k] for name, (*_, columns) in made.items()}).alias(c) for k, c in enumerate(MATCH)])


def evaluate(facts: Facts, rules: tuple[Rule, ...] = DEFAULT_RULES, settings: Mapping[str, Setting] | None = None) -> DataFrame:
    """Findings of all rules: change_id, rule_id, finding_id, evidence_id, weight, explanation, remediation and the match."""
    settings = settings or {}
    ids = [r.id for r in rules]
    if "" in ids or len(set(ids)) != len(ids):
        raise ValueError("rule ids must be unique and not empty")
    if unknown := sorted(set(settings) - set(ids)):
        raise ValueError(f"unknown rule setting: {unknown[0]}")
    parts, by_shape = [], []
    for rule in sorted(rules, key=lambda r: r.id):
        setting = settings.get(rule.id, Setting())
        if not setting.enabled:
            continue
        weight = float(rule.weight if setting.weight is None else setting.weight)
        if not math.isfinite(weight):
            raise ValueError(f"rule {rule.id} has a weight that is not finite")
        if rule.shaped is not None:
            by_shape.append((rule, weight, setting.options))
        elif (found := rule.evaluate(facts, setting.options)) is not None:
            parts.append(_whole(found).select(F.lit(rule.id).alias("rule_id"), F.lit(weight).alias("weight"), "*"))
    if by_shape:
        parts.append(_of_shape(facts.files, by_shape))
    if not parts:
        raise ValueError("no rule has evidence to look at")
    out = reduce(DataFrame.unionByName, parts)
    n = F.row_number().over(Window.partitionBy("change_id", "rule_id").orderBy("key")).cast("string")
    name = F.concat_ws(":", "rule_id", n)
    texts = F.create_map(*[x for r in rules for x in (F.lit(r.id), F.struct(F.lit(r.explanation or r.id).alias("explanation"), F.lit(r.remediation).cast("string").alias("remediation")))])[F.col("rule_id")]
    made = {"finding_id": F.concat(name, F.lit(":finding")), "evidence_id": F.concat(name, F.lit(":evidence")), "explanation": texts["explanation"], "remediation": texts["remediation"]}
    return out.withColumns(made)


def evidence(findings: DataFrame) -> DataFrame:
    """The evidence records behind findings: change_id, evidence_id, kind, summary, data, source_paths."""
    return findings.select("change_id", "evidence_id", "kind", "summary", "data", F.col("sources").alias("source_paths"))
