"""The batch analysis: facts of many changes to one nested result per change."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import categories
from ..operators import graph, ownership, relations, rules, scoring
from ..sources.texts import parse
from .config import Config
from .cut import cut
from .registry import BUILT_IN, LanguageAdapter

#: What a result says where evidence is partial or absent.
LIMITATIONS = {
    "graph": "Dependency graph and test relationships represent the head tree; deleted modules may be absent.",
    "tests": "Test relationships are inferred from path conventions; tests and coverage are not executed.",
    "no-graph": "Dependency graph and test relationships were omitted because the clean worktree did not match the analyzed head revision.",
    "no-owners": "Ownership evidence was omitted because the clean worktree did not match the analyzed head revision.",
}


def issue_limitations(issues: DataFrame, what: str) -> DataFrame:
    """change_id, limitation for parse issues: ``what`` unavailable: kind (line n)."""
    line = F.when(F.col("line").isNotNull(), F.concat(F.lit(" (line "), F.col("line").cast("string"), F.lit(")"))).otherwise("")
    return issues.select(F.col("key").alias("change_id"), F.concat(F.lit(f"{what} unavailable: "), "issue", line, F.lit(".")).alias("limitation"))


def module_limitations(issues: DataFrame, what: str = "Language analysis issue") -> DataFrame:
    """limitation for issues of modules (issue and, where there is one, path)."""
    path = F.when(F.col("path").isNotNull(), F.concat(F.lit(" ("), "path", F.lit(")"))).otherwise("")
    return issues.select(*[c for c in issues.columns if c not in ("issue", "path")], F.concat(F.lit(f"{what}: "), "issue", path, F.lit(".")).alias("limitation"))


def prepared(files: DataFrame, config: Config) -> DataFrame:
    """Changed files without the ignored ones, classified."""
    kept = ownership.ignore(files, list(config.ignore)) if config.ignore else files
    return kept.withColumn("categories", categories("path", config.language))


@dataclass(frozen=True)
class Index:
    """What a language's adapter makes of a tree: modules, resolved references, graph edges, tests and issues."""

    modules: DataFrame
    references: DataFrame
    edges: DataFrame
    tests: DataFrame
    issues: DataFrame


def index(sources: DataFrame, language: str, adapters: tuple[LanguageAdapter, ...] = BUILT_IN, ignore: tuple[str, ...] = ()) -> Index:
    """Sources (repository_id, path, text) through the adapter of their language.

    A source with an issue keeps what could be read of it. Ignored modules go
    after resolution, with the references to them.
    """
    found = [a for a in adapters if a.id == language]
    if not found:
        raise ValueError(f"no adapter for {language}")
    keyed = sources.select("repository_id", "path", "text", F.concat_ws("\x1f", F.col("repository_id").cast("string"), "path").alias("source"))
    rows, issues = parse(keyed, "source", found[0].imports, found[0].schema, ("path", "text"))
    repository = F.split("key", "\x1f")[0].cast(sources.schema["repository_id"].dataType).alias("repository_id")
    modules = sources.select("repository_id", "path").distinct()
    resolved = found[0].resolve(modules, rows.select(repository, *[c for c in rows.columns if c != "key"]))
    kept, references = graph.included(modules, resolved, list(ignore))
    return Index(kept, references, graph.from_imports(references), relations.test_relationships(kept, language), issues)


# the fields of a result's evidence and findings, by the columns of rules.evaluate
EVIDENCE = {"id": "evidence_id", "kind": "kind", "summary": "summary", "data": "data", "source_paths": "sources"}
FINDING = {"id": "finding_id", "rule_id": "rule_id", "title": "title", "severity": "severity", "weight": "weight", "explanation": "explanation", "evidence_id": "evidence_id", "affected_paths": "paths", "remediation": "remediation"}


def _in_order(fields: dict[str, str]) -> Column:
    """A list of structs in rule and match order; a finding's evidence is a list of one."""
    rows = F.array_sort(F.collect_list(F.struct("rule_id", "key", *[F.col(c).alias(f"f_{name}") for name, c in fields.items()])))
    field = lambda row, name: F.array(row["f_evidence_id"]).alias("evidence_ids") if name == "evidence_id" else row[f"f_{name}"].alias(name)
    return F.transform(rows, lambda row: F.struct(*[field(row, name) for name in fields]))


def analyze(changes: DataFrame, facts: rules.Facts, config: Config | None = None, rule_set: tuple[rules.Rule, ...] = rules.DEFAULT_RULES, limitations: DataFrame | None = None) -> DataFrame:
    """change_id, base, head, score, classification, files, evidence, findings, contributions, limitations.

    ``facts.files`` are classified here. A setting for the fan-in rule is only
    added where the rule set has that rule.
    """
    config = config or Config()
    files = cut(prepared(facts.files, config))
    facts = replace(facts, files=files, areas=config.areas or facts.areas)
    settings = dict(config.rules)
    if any(r.id == "high-fan-in" for r in rule_set):
        own = settings.get("high-fan-in", rules.Setting())
        settings["high-fan-in"] = replace(own, options={"maxTraversalDepth": config.analysis["maxTraversalDepth"], **own.options})
    found = cut(rules.evaluate(facts, rule_set, settings))
    contributed = scoring.contributions(found)
    scored = scoring.scores(changes, contributed, config.thresholds)
    said = [k for k in ("graph", "tests") if facts.graph_nodes is not None] + ["no-graph"] * (facts.graph_nodes is None) + ["no-owners"] * (facts.owners is None)
    notes = changes.select("change_id", F.explode(F.array(*[F.lit(LIMITATIONS[k]) for k in said])).alias("limitation"))
    if limitations is not None:
        notes = notes.unionByName(limitations)
    parts = [
        files.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("path", "status", "additions", "deletions", "categories"))).alias("files")),
        found.groupBy("change_id").agg(_in_order(EVIDENCE).alias("evidence"), _in_order(FINDING).alias("findings")),
        contributed.groupBy("change_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "weight", "finding_ids"))).alias("contributions")),
        notes.groupBy("change_id").agg(F.array_sort(F.collect_set("limitation")).alias("limitations")),
    ]
    out = reduce(lambda a, b: a.join(b, "change_id", "left"), parts, changes.select("change_id", "base", "head").join(scored, "change_id"))
    lists = ("files", "evidence", "findings", "contributions", "limitations")
    return out.select("change_id", "base", "head", "score", "classification", *[F.coalesce(c, F.expr(f"filter({c}, x -> false)"), F.array().cast(out.schema[c].dataType)).alias(c) for c in lists])
