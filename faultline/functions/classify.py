"""Multi-label path classification as one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category vocabulary in result order, and the path tests of each.
CATEGORIES = ("source", "test", "documentation", "dependency", "lockfile", "generated", "infrastructure", "ci", "migration", "configuration", "asset", "other")
SOURCE = {"typescript": r"\.(?:[cm]?[jt]sx?|vue|svelte)\z", "python": r"\.pyi?\z"}
TEST = {
    "typescript": r"(?:^|/)(?:__tests__|test|tests|spec)(?:/|\z)|\.(?:test|spec)\.[^/]+\z",
    "python": r"(?:^|/)tests/(?s:.)*\.py\z|(?:^|/)(?:test_[^/]+|[^/]+_test)\.py\z",
}
PATH_TESTS = {
    "documentation": r"(?:^|/)docs?(?:/|\z)|(?:^|/)(?:readme|changelog|contributing|license)(?:\.[^/]*)?\z|\.mdx?\z",
    "dependency": r"(?:^|/)(?:package\.json|deno\.jsonc?|bun\.lockb?|package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml)\z",
    "lockfile": r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?)\z",
    "generated": r"(?:^|/)(?:dist|build|coverage|generated|vendor)(?:/|\z)|\.generated\.[^/]+\z",
    "infrastructure": r"(?:^|/)(?:dockerfile(?:\.[^/]*)?|compose\.ya?ml|k8s|kubernetes|terraform)(?:/|\z)|\.tf(?:vars)?\z",
    "ci": r"(?:^|/)(?:\.github/workflows|\.circleci)(?:/|\z)|(?:^|/)(?:\.gitlab-ci|azure-pipelines)\.ya?ml\z",
    "migration": r"(?:^|/)(?:migrations?|prisma/migrations)(?:/|\z)",
    "configuration": r"(?:^|/)(?:tsconfig(?:\.[^/]*)?\.json|\.editorconfig|\.prettierrc(?:\.[^/]+)?|[^/]+\.config\.[^/]+)\z",
    "asset": r"\.(?:avif|gif|ico|jpe?g|png|svg|webp|woff2?|ttf|mp3|mp4|wav)\z",
}


def tests(language: str = "typescript") -> dict[str, str]:
    """Category to pattern, for every category that a pattern decides."""
    if language not in SOURCE:
        raise ValueError(f"unknown language: {language}")
    return {"source": SOURCE[language], "test": TEST[language], **PATH_TESTS}


def normalized(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def categories(path: Column | str, language: str = "typescript") -> Column:
    """Categories of a path in vocabulary order; ``other`` if there is none."""
    low = normalized(F.col(path) if isinstance(path, str) else path)
    found = F.transform(F.array(low), lambda p: F.array_compact(F.array(*[F.when(p.rlike(t), F.lit(c)) for c, t in tests(language).items()])))
    # bound in lambdas, so that the path is folded and the tests run once
    return F.transform(found, lambda f: F.when(F.size(f) == 0, F.array(F.lit("other"))).otherwise(f))[0]


def is_kind(wanted: str, *without: str) -> Column:
    """Whether ``categories`` has ``wanted`` and none of the others, reading the column once."""
    return F.array_intersect("categories", F.array(*map(F.lit, (wanted, *without)))) == F.array(F.lit(wanted))
