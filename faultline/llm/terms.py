"""Hashed TF-IDF terms of texts, vectorised, and corpus-wide document counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text
from .windows import _BYTE, Rolling, mix, word_spans

_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _BYTE[_FOLD]


_MARK = np.zeros(256, bool)
_MARK[[c for c in range(128) if not chr(c).isalnum()]] = True


def words(texts: list[bytes], bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bytes, starts, ends, hashes and text index of all words, ASCII case folded.

    ``bare`` folds all letters and leaves up to three marks at either end of a
    word out of its hash.
    """
    if bare:
        texts = [t if t.isascii() else t.decode("utf-8", "replace").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    start, end = word_spans(data)
    first, last = start, end
    if bare:
        first, last = start.copy(), end.copy()
        for edge, step in ((first, 1), (last, -1)):
            some = np.arange(len(edge))
            for _ in range(3):
                some = some[_MARK[data[edge[some] - (step < 0)]] & (last[some] - first[some] > 1)]
                edge[some] += step
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (4 << 20), "right")))
        hashes[at:to] = Rolling(_FOLDED[data[start[at] : end[to - 1]]]).at(first[at:to] - start[at], last[at:to] - start[at])
        at = to
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, begins)))
    return data, start, end, mix(hashes ^ (last - first).astype(np.uint64)), doc


def document_counts(docs: DataFrame, matrix, dimensions: int) -> tuple[int, np.ndarray]:
    """Number of texts, and of those with each term, over the whole corpus.

    Each task sums its own rows first; what is shuffled is one row per term and
    task, what the driver gets one per term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimensions, np.int64), 0
        for batch in batches:
            for _, _, texts in slices(batch, 0):
                made, rows = matrix(texts)
                total += made
                n += rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[n, total[some]])], names=["term", "n"])

    made = docs.select(whole_text().alias("text")).mapInArrow(run, "term int, n long")
    counts = {r["term"]: r["n"] for r in made.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    out = np.zeros(dimensions, np.int64)
    for k, v in counts.items():
        if k >= 0:
            out[k] = v
    return int(counts.get(-1, 0)), out
