"""Line dedup over overlapping three-line windows, in DataFrame functions.

A window is three consecutive lines with a word in at least one of them. The
first occurrence in the corpus (smallest doc_id, then line) stays; the lines of
all later ones go, overlapping windows merged. Windows are compared by two
64-bit hashes. Documents under three lines, and null texts, are left alone.
Rows with the same doc_id and text count as one document; each is returned.
A null doc_id is the smallest. The lines of a very long text are held at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stash

WINDOW = 3
_KEY = ("id", "fold")


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """id, fold, at, h1, h2: one row per window."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("fold"), F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= size)
    joined = F.expr(f"transform(sequence(0, size(lines) - {size}), i -> array_join(slice(lines, i + 1, {size}), '\n'))")
    each = lines.select(*_KEY, F.posexplode(joined).alias("at", "window")).where(F.col("window").rlike(r"[^\x20\x09-\x0D]"))
    return each.select(*_KEY, "at", F.xxhash64("window").alias("h1"), F.xxhash64(F.lit(1), "window").alias("h2"))


def covered(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """id, fold, starts, ends: merged line runs that go, one row per document with any."""
    made = windows(docs, size)
    place = F.struct("id", "fold", "at")
    first = stash(made.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"), "repeated")
    later = join_hot(made, first, ["h1", "h2"], "n").where("NOT (first <=> struct(id, fold, at))")
    places = later.groupBy(*_KEY).agg(F.array_sort(F.collect_set("at")).alias("p"))
    starts = F.expr(f"filter(p, (x, i) -> i = 0 OR x - p[greatest(i - 1, 0)] > {size})")
    ends = F.expr(f"transform(filter(p, (x, i) -> i = size(p) - 1 OR p[least(i + 1, size(p) - 1)] - x > {size}), x -> x + {size})")
    return places.select(*_KEY, starts.alias("starts"), ends.alias("ends"))


def dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut and ``lines_removed`` (long) added."""
    gone = covered(docs, size).withColumnsRenamed({"id": "gone_id", "fold": "gone_fold"})
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("fold"))
    both = row.join(gone, row["id"].eqNullSafe(gone["gone_id"]) & (row["fold"] == gone["gone_fold"]), "left")
    both = both.withColumn("lines", F.when(F.col("starts").isNotNull(), F.split("row.text", "\n", -1)))
    kept = F.expr("array_join(flatten(zip_with(concat(array(0), ends), concat(starts, array(size(lines))), (a, b) -> slice(lines, a + 1, b - a))), '\n')")
    removed = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (s, x) -> s + x)")
    text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(kept)
    return both.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns], F.coalesce(removed, F.lit(0).cast("long")).alias("lines_removed"))

