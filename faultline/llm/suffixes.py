"""Exact substring dedup over bytes, by two-stage suffix sorting.

The places where the corpus may repeat are located by sampled anchors (see
windows.py); the stretches around every anchor that occurs again are dealt to
blocks by anchor, so that equal strings meet in one block. Each block builds a
suffix array in two stages: only suffixes smaller than their successor are
sorted directly, all others are induced by scanning the buckets in order, and
adjacent common prefixes then tell which strings are equal. An anchor with very
many places is split over blocks, whose first occurrences are compared once
more by a 128-bit hash of the string.

Every byte covered by a string of ``size`` bytes that also starts earlier goes:
under a smaller doc_id, or earlier in the same row. Rows that share a doc_id
are documents of their own, none of them earlier than the other, so of strings
that only such rows share all stay. A null text is empty. A null doc_id is the
smallest. Very long texts are scanned in segments; a text's places are held at
once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts, slices, stash, unstash
from .windows import PER_BLOCK, RUNS, Rolling, _BYTE, byte_units, cover, finish, marked, mix, per_text, repeated, run_rows, scan, with_marks

SIZE = 100
GRAM = 28
#: Bytes that one suffix array is built over.
ARRAY_BYTES = 2 << 20


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of ``text`` ordered by at least the first ``depth`` bytes that follow.

    With ``wanted`` (a flag per place) only these, and those that they are induced from.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]  # last place of each run
    follow = np.r_[text[ends[1:]].astype(np.int16), -1]
    lengths = np.diff(np.r_[-1, ends])
    rising = np.repeat(text[ends] < follow, lengths)
    if wanted is None:
        wanted = np.ones(n, bool)
    else:  # whoever is not sorted directly needs its successors, up to one that is
        stop = np.flatnonzero(wanted & np.r_[~wanted[1:], True])
        direct = np.r_[np.flatnonzero(rising), n - 1]
        reach = np.r_[direct, n - 1][np.searchsorted(direct, stop)]
        change = np.bincount(stop, minlength=n + 1)[: n + 1] - np.bincount(reach, minlength=n + 1)[: n + 1]
        wanted = wanted | (np.r_[0, np.cumsum(change)[: n - 1]] > 0)
    direct = np.flatnonzero(rising & wanted)
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(depth, np.uint8)], depth)
    order = direct[np.argsort(np.ascontiguousarray(rows[direct]).view(f"S{depth}").ravel(), kind="stable")] if len(direct) else direct
    firsts = text[order]
    bounds = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[-1]:
        waiting[text[-1]].append(np.array([n - 1]))  # the last suffix is larger than its (empty) successor
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):  # one, two, three ... times this byte, then a smaller one
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[(text[level] == c) & wanted[level]]
        bucket.append(order[bounds[c] : bounds[c + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        out.append(full)
        before = full[full > 0] - 1
        before = before[wanted[before]]
        chars = text[before]
        up = chars > c
        before, chars = before[up], chars[up]
        by = np.argsort(chars, kind="stable")
        before, chars = before[by], chars[by]
        if not len(chars):
            continue
        cuts = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
        for s, e in zip(cuts, [*cuts[1:], len(chars)], strict=True):
            waiting[chars[s]].append(before[s:e])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def equal_neighbours(text: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Whether the common prefix of each place with the one before is at least ``size``, by words of eight bytes."""
    whole = -(-size // 8) * 8
    rows = np.lib.stride_tricks.sliding_window_view(np.r_[text, np.zeros(whole, np.uint8)], whole)
    same = np.zeros(len(places), bool)
    for k in range(1, len(places), 20_000):
        to = min(len(places), k + 20_000)
        words = rows[places[k - 1 : to]].view("<u8")
        if whole > size:
            words[:, -1] &= np.uint64((1 << 8 * (8 - whole + size)) - 1)
        same[k:to] = (words[1:] == words[:-1]).all(1)
    return same


def _contexts(size: int):
    """The bytes around each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, texts, marks, row in marked(batch):
                p0, p1 = marks["p0"].tolist(), marks["p1"].tolist()
                around = [texts[i][a : b + size] for i, a, b in zip((row - first).tolist(), p0, p1, strict=True)]
                columns = [marks["h"], marks["salt"], marks["split"], ids[row], folds[row], marks["p0"], marks["p1"]]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(around, pa.binary())], names=["h", "salt", "split", "id", "fold", "p0", "p1", "around"])

    return run


def compare(rows: np.ndarray, around: list[bytes], size: int = SIZE) -> Iterator[pa.RecordBatch]:
    """Runs that go, and of split anchors the occurrences that stay, of one block.

    ``rows`` tell id, fold, p0, p1 and split of each stretch.
    """
    text = np.frombuffer(b"".join(around), np.uint8)
    n = np.array([len(x) for x in around])
    begin = np.cumsum(n) - n
    row = np.repeat(np.arange(len(rows), dtype=np.int32), n)
    inside = np.arange(len(text)) - begin[row]
    owned = inside <= (rows["p1"] - rows["p0"])[row]
    order = suffix_array(text, size, owned)
    order = order[owned[order]]
    heads = np.flatnonzero(~equal_neighbours(text, order, size))
    group = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
    doc = rows["id"][row[order]]
    gone = doc > np.minimum.reduceat(doc, heads)[group]
    # of strings that the smallest doc_id has more than once, the later ones in each of its rows
    same = np.flatnonzero(~gone & (np.bincount(group, ~gone) > 1)[group])
    if len(same):
        of, start, fold = group[same], (rows["p0"][row] + inside)[order[same]], rows["fold"][row[order[same]]]
        by = np.lexsort((start, fold, of))
        of, start, fold = of[by], start[by], fold[by]
        own = np.r_[True, (of[1:] != of[:-1]) | (fold[1:] != fold[:-1])]  # a row's first in its group
        gone[same[by]] = start > start[own][np.cumsum(own) - 1]
    marked_at = np.zeros(len(text) + 1, bool)
    marked_at[order[gone]] = True
    first = np.flatnonzero(marked_at[:-1] & ~np.r_[False, marked_at[:-2] & (row[1:] == row[:-1])])
    if len(first):
        last = np.flatnonzero(marked_at[:-1] & ~np.r_[marked_at[1:-1] & (row[1:] == row[:-1]), False])
        at = row[first]
        none = np.zeros(len(at), np.int64)
        yield run_rows(none, none, rows["id"][at], rows["fold"][at], rows["p0"][at] + inside[first], rows["p0"][at] + inside[last] + size)
    again = order[~gone & (rows["split"][row[order]] > 0)]
    if len(again):
        roll, other = Rolling(_BYTE[text]), Rolling(mix(_BYTE[text]))
        at = row[again]
        yield run_rows(roll.at(again, again + size), other.at(again, again + size), rows["id"][at], rows["fold"][at], rows["p0"][at] + inside[again], np.full(len(again), -1))


STRETCH = np.dtype([("split", "<i4"), ("id", "<i8"), ("fold", "<i8"), ("p0", "<i4"), ("p1", "<i4")])


def _blocks(size: int):
    """Blocks of whole anchors, of about ARRAY_BYTES, compared one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []
        total, last = 0, None
        for batch in batches:
            h, salt = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if not len(h):
                continue
            rows = np.empty(len(h), STRETCH)
            for k, name in enumerate(STRETCH.names, 2):
                rows[name] = batch.column(k).to_numpy(zero_copy_only=False)
            around = batch.column(7).to_pylist()
            heads = np.flatnonzero(np.r_[(h[0], salt[0]) != last, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
            reach = np.r_[0, np.cumsum([len(x) for x in around])]
            at = 0
            for k in heads.tolist():
                if total + reach[k] - reach[at] >= ARRAY_BYTES:
                    held.append((rows[at:k], around[at:k]))
                    yield from compare(np.concatenate([r for r, _ in held]), [x for _, xs in held for x in xs], size)
                    held, total, at = [], 0, k
            held.append((rows[at:], around[at:]))
            total += reach[-1] - reach[at]
            last = (h[-1], salt[-1])
        if held:
            yield from compare(np.concatenate([r for r, _ in held]), [x for _, xs in held for x in xs], size)

    return run


def meet_again(found: DataFrame, size: int) -> DataFrame:
    """Runs that go because another block of their anchor has the string earlier.

    Most strings around a frequent anchor occur once; only the others are joined.
    """
    stay = found.where("end < 0").select("w1", "w2", "id", "fold", "start")
    least = stay.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = stay.join(least, ["w1", "w2"]).groupBy("w1", "w2", "id", "fold", "least").agg(F.collect_set("start").alias("starts"))
    later = F.filter("starts", lambda x: (F.col("id") > F.col("least")) | (x > F.array_min("starts")))
    each = rows.select("id", "fold", F.explode(later).alias("start"))
    return each.select("id", "fold", "start", (F.col("start") + size).alias("end"))


def repeated_runs(docs: DataFrame, size: int = SIZE, per_block: int = PER_BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """id, fold, start, end of runs of bytes that occur earlier, and the stashes behind them."""
    marks = stash(repeated(scan(docs, byte_units, GRAM, size, per_block), per_block), "marks")
    around = with_marks(docs, marks).mapInArrow(_contexts(size), "h long, salt long, split int, id long, fold long, p0 int, p1 int, around binary")
    parts = shuffle_parts(docs.sparkSession) * 2
    dealt = around.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt")
    found = stash(dealt.mapInArrow(_blocks(size), RUNS), "blocks")
    runs = found.where("end >= 0").select("id", "fold", "start", "end").unionByName(meet_again(found, size))
    return runs, [marks, found]


def dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans."""
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
                    a, b = cover(starts[i], ends[i])
                    kept = b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)) if len(a) else text
                    out.append((kept, len(text), int((b - a).sum()), len(a)))
                kept, n, gone, spans = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i0, i1 - i0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n, gone, spans))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return finish(docs, runs, run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
