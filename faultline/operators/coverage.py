"""Coverage joins: records, baselines and changed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import is_kind
from ..functions.stats import half_up


def eligible(files: DataFrame) -> DataFrame:
    """Source files that are neither deleted, tests nor generated."""
    return files.where((F.col("status") != "deleted") & is_kind("source", "test", "generated"))


def with_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """lines_found and lines_hit of each file, null where no record is."""
    return files.select("change_id", "path").join(records.select("path", "lines_found", "lines_hit"), "path", "left")


def with_baseline(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline lines by the previous path, or the path itself."""
    was = F.coalesce(F.col("previous_path"), F.col("path")) if "previous_path" in files.columns else F.col("path")
    base = baseline.select(F.col("path").alias("baseline_path"), F.col("lines_found").alias("baseline_found"), F.col("lines_hit").alias("baseline_hit"))
    keyed = files.select("change_id", "path", was.alias("was"))
    return keyed.join(base, keyed["was"] == base["baseline_path"], "left").select("change_id", "path", F.col("was").alias("baseline_path"), "baseline_found", "baseline_hit")


def _up_to(sorted_lines: Column, line: Column) -> Column:
    """How many of an array's sorted lines are at most ``line``, by halving."""
    begin = F.struct(F.lit(0).alias("low"), F.size(sorted_lines).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = ((span["low"] + span["high"]) / 2).cast("int")
        inside = span["low"] < span["high"]
        up = inside & (F.get(sorted_lines, middle) <= line)
        return F.struct(F.when(up, middle + 1).otherwise(span["low"]).alias("low"), F.when(inside & ~up, middle).otherwise(span["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_lines) + 2)).cast("int")), begin, halve, lambda span: span["low"].cast("long"))


def changed_lines(ranges: DataFrame, lines: DataFrame, presence: DataFrame | None = None) -> DataFrame:
    """Changed, instrumented and hit lines of each changed file.

    A path's instrumented lines are one sorted array; a range costs two searches
    in it, however long it is. ``presence`` adds files without any range.
    """
    real = ranges.where("span > 0")
    hit_line = F.when(F.col("hits") > 0, F.col("line"))
    known = lines.groupBy("path").agg(F.array_sort(F.collect_list("line")).alias("all"), F.array_sort(F.collect_list(hit_line)).alias("hit"))
    if presence is not None:
        real = presence.select("change_id", "path").distinct().join(real.select("change_id", "path", "start", "span"), ["change_id", "path"], "left")
    end = F.col("start") + F.col("span") - 1
    within = lambda c: _up_to(F.col(c), end) - _up_to(F.col(c), F.col("start") - 1)
    zero = F.lit(0).cast("long")
    each = real.join(known, "path", "left").select("change_id", "path", F.coalesce(F.col("span").cast("long"), zero).alias("span"), *[F.when(F.col("all").isNotNull(), F.coalesce(within(c), zero)).alias(c) for c in ("all", "hit")])
    out = each.groupBy("change_id", "path").agg(F.sum("span").alias("changed"), F.sum("all").alias("found"), F.sum("hit").alias("hit"))
    return out.select("change_id", "path", "changed", "found", "hit")


def record_issues(records: DataFrame, lines: DataFrame) -> DataFrame:
    """A3: records whose declared totals disagree with their lines."""
    seen = lines.groupBy("path").agg(F.count_distinct("line").alias("n"), F.count_if(F.col("hits") > 0).alias("h"))
    both = records.join(seen, "path", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "h": F.coalesce("h", F.lit(0))})
    return both.where("lines_found <> n OR lines_hit <> h OR lines_hit > lines_found").select("path", "lines_found", "lines_hit", "n", "h")


def percent(hit: Column, found: Column) -> Column:
    """Raw percentage, null where nothing is measurable."""
    return F.when(found > 0, hit.cast("double") * 100 / F.when(found > 0, found))


def concerns(rel: DataFrame, min_line: float = 80, min_changed: float = 80, max_drop: float = 0) -> DataFrame:
    """Reasons per file in order, from raw percentages.

    ``rel`` has change_id, path, lines_found, lines_hit and, with presence flags
    has_baseline and has_changed, the baseline_ and changed columns.
    """
    line, base = percent(F.col("lines_hit"), F.col("lines_found")), percent(F.col("baseline_hit"), F.col("baseline_found"))
    changed = percent(F.col("changed_hit"), F.col("changed_found"))
    measured = F.col("has_changed") & F.col("lines_found").isNotNull() & (F.col("changed_count") > 0) & F.col("changed_found").isNotNull()
    reasons = F.array_compact(
        F.array(
            F.when(F.col("lines_found").isNull() | F.col("lines_hit").isNull(), "missing-record").when(F.col("lines_found") == 0, "no-measurable-lines").when(line < min_line, "below-threshold"),
            F.when(F.col("has_baseline") & (line - base < -max_drop), "coverage-regression"),
            F.when(measured & (F.col("changed_found") == 0), "no-measurable-changed-lines").when(measured & (changed < min_changed), "below-changed-line-threshold"),
        )
    )
    given = ("lines_found", "lines_hit", "baseline_found", "baseline_hit", "changed_count", "changed_found", "changed_hit")
    out = rel.select("change_id", "path", *given, half_up(line).alias("line_percent"), half_up(base).alias("baseline_percent"), half_up(line - base).alias("delta"), half_up(F.when(measured, changed)).alias("changed_percent"), reasons.alias("reasons"))
    return out.where(F.size("reasons") > 0)
