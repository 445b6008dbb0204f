"""Files that a CI run or an evaluation leaves."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import SEGMENT
from .reports import Result, as_json, markdown, plain


def evaluation_json(summary: DataFrame) -> DataFrame:
    """K7: one stable JSON text per segment, in segment order."""
    order = [c for c in SEGMENT if c in summary.columns]
    return summary.orderBy(*order).select(F.to_json(F.struct(*order, *sorted(c for c in summary.columns if c not in order)), {"ignoreNullFields": "false"}).alias("json"))


def ci_outputs(result: Result, report: str, outputs: str, summary: str | None = None) -> None:
    """K5: the JSON report (mode 0600, never through a link), the step's output lines and its summary."""
    handle = os.open(report, os.O_WRONLY | os.O_CREAT | os.O_TRUNC | os.O_NOFOLLOW, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(as_json(result))
    with open(outputs, "a", encoding="utf-8") as f:
        f.write(f"classification={result['classification']}\nscore={plain(result['score'])}\njson-path={report}\n")
    if summary is not None:
        with open(summary, "a", encoding="utf-8") as f:
            f.write(markdown(result))
