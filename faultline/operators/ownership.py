"""Ownership and sensitive-area matching: theta joins of paths and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_match, owner_regex

#: Rule sets up to this size become one expression of literal patterns.
UNROLLED = 200
#: A rule set above this many rows isn't broadcast.
MAX_RULES = 10_000

#: Pairs of a rule and a path of one change.
MAX_MATCHES = 1_000_000

Rule = tuple[str, list[str]]


def compile_rules(rules: list[Rule]) -> list[tuple[int, str, list[str]]]:
    """(ordinal, regex, owners); one unsupported pattern makes the whole set invalid."""
    out = []
    for k, (pattern, owners) in enumerate(rules, 1):
        regex = owner_regex(pattern)
        if regex is None:
            raise ValueError(f"unsupported owner pattern at rule {k}")
        out.append((k, regex, owners))
    if len(out) > MAX_RULES:
        raise ValueError("owner rule limit exceeded")
    return out


def owners_of(path: Column, rules: list[Rule]) -> Column:
    """The owners of the last rule that matches, an empty array if none does."""
    out = None
    for _, regex, owners in reversed(compile_rules(rules)):
        value = F.array(*map(F.lit, owners)).cast("array<string>")
        out = F.when(path.rlike(regex), value) if out is None else out.when(path.rlike(regex), value)
    none = F.array().cast("array<string>")
    return none if out is None else out.otherwise(none)


def within_limit(files: DataFrame, rules: list[Rule], limit: int = MAX_MATCHES) -> None:
    """V3: no change may have more pairs of a rule and a path than the limit."""
    most = files.groupBy("change_id").agg((F.count_distinct("path") * len(rules)).alias("n")).agg(F.max("n")).collect()[0][0]
    if (most or 0) > limit:
        raise ValueError("owner match limit exceeded")


def match(files: DataFrame, rules: list[Rule], unrolled: int = UNROLLED) -> DataFrame:
    """Path and owners for each distinct path of ``files``.

    Distinct paths are matched, not rows. Small rule sets stay inside code
    generation; larger ones join a broadcast rule table of checked size. Files of
    changes are held to the limit of one change.
    """
    if "change_id" in files.columns and len(rules) > unrolled:
        within_limit(files, rules)
    paths = files.select("path").distinct()
    if len(rules) <= unrolled:
        return paths.select("path", owners_of(F.col("path"), rules).alias("owners"))
    table = files.sparkSession.createDataFrame(compile_rules(rules), "ordinal int, regex string, owners array<string>")
    hit = paths.join(F.broadcast(table), F.expr("path RLIKE regex"), "left")
    return hit.groupBy("path").agg(F.coalesce(F.max_by("owners", "ordinal"), F.array().cast("array<string>")).alias("owners"))


def sensitive(files: DataFrame, areas: dict[str, list[str]]) -> DataFrame:
    """change_id, area, path for every file in every area it matches."""
    hits = F.array_compact(F.array(*[F.when(any_match("path", patterns), F.lit(area)) for area, patterns in sorted(areas.items())]))
    return files.select("change_id", "path", F.explode(hits).alias("area"))


def ignore(rows: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    """Rows whose path no pattern matches."""
    return rows.where(~any_match(column, patterns))
