"""Parsing whole artifacts on the cluster.

A parser takes one artifact's text and returns rows, or raises ``ParseError``
with its issues. ``parse`` applies it to a table of artifacts. Evidence is all or
nothing: an artifact with an issue gives issues only, unless its parser says which
rows it found all the same. Who doesn't look at the issues asks for ``strict``, where
one fails the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.cut import cut


class ParseError(ValueError):
    """issues: (kind, line or None), and rows that stand in spite of them."""

    def __init__(self, *issues: tuple[str, int | None], rows: Iterable[tuple] = ()) -> None:
        super().__init__(", ".join(f"{k}:{n}" if n else k for k, n in issues))
        self.issues, self.rows = list(issues), list(rows)


Parser = Callable[..., Iterable[tuple]]

#: Rows after which a task hands over what it has parsed.
ROWS = 50_000


def parse(artifacts: DataFrame, key: str, parser: Parser, schema: str, columns: tuple[str, ...] = ("text",), strict: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of all artifacts. ``columns`` are the parser's arguments; with ``strict`` an issue is an error."""
    names = T.StructType.fromDDL(schema).names
    full = f"key string, issue string, issue_line int, {schema}"

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "issue", "issue_line", *names], dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for one, *values in frame.itertuples(index=False):
                try:
                    out += [(one, None, None, *row) for row in parser(*values, **options)]
                except ParseError as error:
                    if strict:
                        raise ValueError(f"artifact {one!r} cannot be read: {error}") from error
                    out += [(one, kind, line, *[None] * len(names)) for kind, line in error.issues]
                    out += [(one, None, None, *row) for row in error.rows]
                if len(out) >= ROWS:
                    yield table(out)
                    out = []
            yield table(out)

    made = cut(artifacts.select(F.col(key).cast("string"), *columns).mapInPandas(run, full))
    return made.where("issue IS NULL").drop("issue", "issue_line"), made.where("issue IS NOT NULL").select("key", "issue", F.col("issue_line").alias("line"))
