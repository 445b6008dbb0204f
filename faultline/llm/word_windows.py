"""Substring dedup over words, by level-wise doubling.

Level 0 holds anchors of ``size // 4 + 1`` words (9 for 35). Every anchor that
occurs again is extended to twice the length; those repeated at that length are
extended again, now to whole windows, and what repeats there goes.

Every word of every repeated window goes, its first occurrence too. A null text
has no words. Each row is a document of its own, repeated rows and rows that
share a doc_id too: a window that two equal rows have starts twice, so it goes
from both. Level hashes have 64 bits. Very long texts are scanned in segments; a
text's words and places are held at once. A null doc_id is a doc_id like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, slices, stash, unstash
from .windows import PER_BLOCK, RUNS, Rolling, binaries, cover, finish, marked, merged_rows, per_text, repeated, run_rows, scan, with_marks, word_units

SIZE = 35
#: Whole windows that a step of the last level holds at once, and a few more.
AT_ONCE = 500_000
ROW = np.dtype([("split", "?"), ("id", "<i8"), ("fold", "<i8"), ("p0", "<i4")])


def extended(size: int, gram: int):
    """Two windows of doubled length per place, with the whole windows around each.

    A whole window that has room to the right of its anchor belongs to the
    doubling to the right, any other to the doubling to the left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, texts, marks, row in marked(batch):
                units, bounds = word_units(texts)
                roll = Rolling(units)
                begin = bounds[row - first]
                p0, p1, q = (begin + marks[name] for name in ("p0", "p1", "q"))
                turn = q + 2 * gram - size  # first start with room to the right
                sides = [(np.maximum(p0, turn), p1, q), (p0, np.minimum(p1, turn - 1), q - gram)]
                for side, (lo, hi, at) in enumerate(sides):
                    some = np.flatnonzero(lo <= hi)
                    if not len(some):
                        continue
                    lo, hi, at = lo[some], hi[some], at[some]
                    n = hi - lo + 1
                    bound = np.r_[0, np.cumsum(n)]
                    starts = np.repeat(lo - bound[:-1], n) + np.arange(n.sum())
                    double = roll.at(at, at + 2 * gram) ^ np.uint64(side)
                    i = row[some]
                    columns = [double.view(np.int64), marks["salt"][some], marks["split"][some] > 0, ids[i], folds[i], (lo - begin[some]).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), binaries(roll.at(starts, starts + size), bound)], names=["double", "salt", "split", "id", "fold", "p0", "whole"])

    return run


def _levels(size: int):
    """Runs of whole windows that repeat, of doublings that repeat; rows come sorted by doubling."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        double, salt, rows = (np.concatenate(x) for x in list(zip(*held, strict=True))[:3])
        whole = [x for *_, xs in held for x in xs]
        new = np.r_[True, (double[1:] != double[:-1]) | (salt[1:] != salt[:-1])]
        of = np.cumsum(new) - 1
        alive = np.flatnonzero((np.bincount(of) > 1)[of] | rows["split"])
        if not len(alive):
            return
        of, rows = of[alive], rows[alive]
        n = np.array([len(whole[k]) // 8 for k in alive.tolist()])
        w = np.frombuffer(b"".join(whole[k] for k in alive.tolist()), np.uint64)
        row = np.repeat(np.arange(len(alive)), n)
        start = rows["p0"][row] + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((w, of[row]))
        row, start, w = row[order], start[order], w[order]
        fresh = np.r_[True, (w[1:] != w[:-1]) | (of[row[1:]] != of[row[:-1]])]
        same = np.diff(np.r_[np.flatnonzero(fresh), len(w)])
        again = np.repeat(same > 1, same)
        if again.any():
            i, f, a, b = merged_rows(rows[row[again]], start[again], start[again] + size)
            none = np.zeros(len(i), np.int64)
            yield run_rows(none, none, i, f, a, b)
        meet = np.flatnonzero(fresh & rows["split"][row])  # one of each, and whether it has others here
        if len(meet):
            yield run_rows(w[meet], again[meet].astype(np.int64), rows["id"][row[meet]], rows["fold"][row[meet]], start[meet], np.full(len(meet), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size_held, last = 0, None
        for batch in batches:
            double, salt = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(double):
                continue
            rows = np.empty(len(double), ROW)
            for k, name in enumerate(ROW.names, 2):
                rows[name] = batch.column(k).to_numpy(zero_copy_only=False)
            whole = batch.column(6).to_pylist()
            heads = np.flatnonzero(np.r_[(double[0], salt[0]) != last, (double[1:] != double[:-1]) | (salt[1:] != salt[:-1])])
            reach = np.r_[0, np.cumsum([len(x) // 8 for x in whole])]
            at = 0
            for k in heads.tolist():
                if size_held + reach[k] - reach[at] >= AT_ONCE:
                    held.append((double[at:k], salt[at:k], rows[at:k], whole[at:k]))
                    yield from settle(held)
                    held, size_held, at = [], 0, k
            held.append((double[at:], salt[at:], rows[at:], whole[at:]))
            size_held += reach[-1] - reach[at]
            last = (double[-1], salt[-1])
        if held:
            yield from settle(held)

    return run


def meet_again(found: DataFrame, size: int) -> DataFrame:
    """Runs of windows that are alone in their block, but not among the blocks of their anchor."""
    once = found.where("end < 0")
    again = once.groupBy("w1").agg(F.count("*").alias("n")).where("n > 1").select("w1")
    each = once.where("w2 = 0").join(again, "w1")
    return each.select("id", "fold", "start", (F.col("start") + size).alias("end"))


def repeated_runs(docs: DataFrame, size: int = SIZE, per_block: int = PER_BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """id, fold, start, end of runs of repeated words, and the stashes behind them."""
    gram = size // 4 + 1
    marks = stash(repeated(scan(docs, word_units, gram, size, per_block), per_block), "marks")
    level = with_marks(docs, marks).mapInArrow(extended(size, gram), "double long, salt long, split boolean, id long, fold long, p0 int, whole binary")
    dealt = level.repartition(shuffle_parts(docs.sparkSession), "double", "salt").sortWithinPartitions("double", "salt")
    found = stash(dealt.mapInArrow(_levels(size), RUNS), "doubled")
    runs = found.where("end >= 0").select("id", "fold", "start", "end").unionByName(meet_again(found, size))
    return runs, [marks, found]


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed."""
    runs, made = repeated_runs(docs, size)
    runs = stash(runs, "runs")
    for x in made:
        unstash(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = per_text(batch, 2), per_text(batch, 3)
            for i0, i1, texts in slices(batch, 1):
                out = []
                for i, text in enumerate(texts, i0):
                    words = text.split()
                    a, b = cover(starts[i], ends[i])
                    removed = int((b - a).sum())
                    if removed:
                        words = [w for x, y in zip([0, *b.tolist()], [*a.tolist(), len(words)], strict=True) for w in words[x:y]]
                    out.append((b" ".join(words).decode(), len(words) + removed, removed))
                kept, n, gone = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i0, i1 - i0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "kept", "n_words", "n_removed"])

    return finish(docs, runs, run, "doc_id long, kept string, n_words long, n_removed long")

