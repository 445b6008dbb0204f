"""Statistics as Column functions, with the reference rounding and zero rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
Z = 1.959963984540054
TIERS = ("routine", "focused", "intensive", "exceptional")
CLASSES = ("low", "moderate", "high", "critical")
LIMITATIONS = (
    ("worktree", "worktree"),
    ("language index", "language-index"),
    ("language-index", "language-index"),
    ("language analysis", "language-index"),
    ("revision source reads", "public-surface"),
    ("python public-surface", "public-surface"),
    ("public surface", "public-surface"),
    ("public-surface", "public-surface"),
    ("ownership", "ownership"),
    ("baseline coverage", "baseline-coverage"),
    ("baseline-coverage", "baseline-coverage"),
    ("changed-line", "changed-lines"),
    ("changed line", "changed-lines"),
    ("coverage", "coverage"),
    ("dependency graph", "graph"),
    ("graph", "graph"),
    ("artifact provenance", "artifact-provenance"),
    ("artifact-provenance", "artifact-provenance"),
)
LIMITATION_CATEGORIES = ("worktree", "language-index", "public-surface", "ownership", "coverage", "changed-lines", "baseline-coverage", "graph", "artifact-provenance", "other")
UNAVAILABLE_REASONS = ("revision-unavailable", "invalid-result", "resource-limit", "operational-error", "other")
SPLITS = ("development", "forward-time", "unseen-repository")
STRATA = ("representative", "signal-enriched")


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.when(whole == 0, 1).otherwise(whole))


def wilson(k: Column, n: Column) -> Column:
    """Struct of rate and 95 % bounds; zeros for n = 0."""
    m = F.when(n == 0, 1).otherwise(n).cast("double")
    p = k.cast("double") / m
    low_high = []
    for sign in (-1, 1):
        x = (p + Z * Z / (2 * m) + sign * Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)
        low_high.append(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    zero = F.lit(0.0)
    return F.struct(F.when(n == 0, zero).otherwise(p).alias("rate"), F.when(n == 0, zero).otherwise(low_high[0]).alias("lower"), F.when(n == 0, zero).otherwise(low_high[1]).alias("upper"))


def change_size(files: Column, lines: Column) -> Column:
    """P19."""
    return F.when((files <= 5) & (lines <= 100), "small").when((files <= 20) & (lines <= 500), "medium").otherwise("large")


def limitation_category(text: Column) -> Column:
    """P20: the first prefix that fits."""
    low = F.lower(F.trim(text))
    out = F.when(low.startswith(LIMITATIONS[0][0]), LIMITATIONS[0][1])
    for prefix, category in LIMITATIONS[1:]:
        out = out.when(low.startswith(prefix), category)
    return out.otherwise("other")


def ordinal(value: Column, names: tuple[str, ...]) -> Column:
    """Place in a vocabulary from 0."""
    return (F.array_position(F.array(*map(F.lit, names)), value) - 1).cast("int")


def classify_score(score: Column, thresholds: tuple[float, float, float] = (20, 50, 80)) -> Column:
    """P22; thresholds are finite, not negative and strictly increasing."""
    moderate, high, critical = thresholds
    if not 0 <= moderate < high < critical < float("inf"):
        raise ValueError("thresholds must be finite, not negative and strictly increasing")
    return F.when(score >= critical, "critical").when(score >= high, "high").when(score >= moderate, "moderate").otherwise("low")


def gate(classification: Column, fail_on: str) -> Column:
    """Exit code 2 at or above ``fail_on``, else 0."""
    if fail_on == "none":
        return F.lit(0)
    return F.when(ordinal(classification, CLASSES) >= CLASSES.index(fail_on), 2).otherwise(0)
