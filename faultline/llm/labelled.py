"""What the two learned operators share: folds and a bounded labelled sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of these folds of crc32(doc_id) mod 4 are never learned from.
HELD_OUT = 2


def held_out() -> Column:
    """A null doc_id counts as the empty string and is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def sample_rows(labelled: DataFrame, label: str, per_label: int, max_labels: int, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About ``per_label`` rows of each label, at most 1.2 times as many.

    Rows are chosen by a hash of their ``key`` against a threshold from the
    label's count, so no label's rows meet in one task. Column ``order`` ranks
    them. The counts of at most ``max_labels`` labels are broadcast.
    """
    scale = 1 << 30
    share = F.least(F.lit(1.0), 1.2 * per_label / F.col("rows_"))
    counts = labelled.groupBy(F.col(label).alias("label_")).agg(F.count("*").alias("rows_")).limit(max_labels).select("label_", (share * scale).cast("long").alias("chance_"))
    order = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(scale))
    joined = labelled.withColumn("order", order).join(F.broadcast(counts), F.col(label) == F.col("label_"))
    return joined.where(F.col("order") <= F.col("chance_")).drop("label_", "chance_")


def first_of_each(rows: list, label: str, per_label: int) -> list:
    """The collected rows with the lowest ``order``, ``per_label`` of each label; ties go by ``tie``, a hash of the text."""
    taken: dict = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["order"], r["tie"], str(r[label]))):
        taken[r[label]] = taken.get(r[label], 0) + 1
        if taken[r[label]] <= per_label:
            out.append(r)
    return out
