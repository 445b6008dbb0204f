"""Micro-batches of change facts through the batch plan (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.classify import categories
from ..operators import rules, scoring

FILE_RULES = tuple(r for r in rules.DEFAULT_RULES if r.id in ("dependency-manifest", "infrastructure", "large-change", "migration", "multi-area-change"))


def score_files(files: DataFrame, settings: dict[str, rules.Setting] | None = None) -> DataFrame:
    """Scores from the rules that need changed files only."""
    facts = rules.Facts(files.withColumn("categories", categories("path")))
    return scoring.scores(files.select("change_id"), scoring.contributions(rules.evaluate(facts, FILE_RULES, settings)))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, settings: dict[str, rules.Setting] | None = None) -> StreamingQuery:
    """Scores each micro-batch of whole changes and gives it to ``sink`` with its id.

    A batch that is run again after a failure has the same id, so a sink that
    writes by id is exactly-once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(score_files(batch, settings).withColumn("batch", F.lit(batch_id)), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
