"""Repeated fixed-length windows over a corpus, found through sampled anchors.

Windows of ``size`` units (bytes or words) are too many to shuffle. Each window
therefore names one anchor, the short gram inside it with the smallest hash;
equal windows name equal anchors, and neighbouring windows mostly name the same
one. What is shuffled is one packed place per anchor: the row it is in and the
span of window starts [p0, p1] that name it. Anchors that occur once drop out;
the places of all others are dealt to blocks of at most ``per_block`` places,
and what repeats there is for the operator's own method to decide. Nothing is
decided by anchors.

Places of one anchor leave a task as one row, and an anchor with many of them
as full blocks of their own, so that a passage which a third of all documents
share does not meet in one task.

A row is known by its doc_id and a hash of its text. Rows equal in both have
the same windows and lose the same ones; rows that share a doc_id only are
documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, doc_key, fold, shuffle_parts, slices, whole_text

#: Places that a scanning task merges at once.
MERGE_ROWS = 400_000
#: Places of one anchor that one block takes.
PER_BLOCK = 2_000
#: A place as the scan packs it, and as the block's deal hands it to its text.
PLACE = np.dtype([("id", "<i8"), ("fold", "<i8"), ("p0", "<i4"), ("p1", "<i4"), ("q", "<i4")])
MARK = np.dtype([("h", "<i8"), ("salt", "<i8"), ("split", "<i4"), ("p0", "<i4"), ("p1", "<i4"), ("q", "<i4")])
_LOW = np.uint64((1 << 24) - 1)
_R = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            full = np.full(n, r, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0][:n], _powers[1][:n]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Rolling:
    """Hashes of any run of units, from prefix sums."""

    def __init__(self, units: np.ndarray) -> None:
        forward, self.back = powers(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * forward[:-1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, and where each text begins."""
    return _BYTE[np.frombuffer(b"".join(texts), np.uint8)], np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    solid = ~_SPACES[data]
    edge = np.flatnonzero(np.diff(np.r_[False, solid, False].view(np.int8)))
    return edge[::2], edge[1::2]


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and where each text's words begin."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    begins = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    start, end = word_spans(data)
    units = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # by runs of words, so that the powers stay short
        to = max(at + 1, int(np.searchsorted(end, start[at] + 2 * CHUNK_BYTES, "right")))
        a, b = start[at:to] - start[at], end[at:to] - start[at]
        units[at:to] = Rolling(_BYTE[data[start[at] : end[to - 1]]]).at(a, b) ^ mix((b - a).astype(np.uint64))
        at = to
    return mix(units), np.searchsorted(start, begins).astype(np.int64)


def anchors(units: np.ndarray, bounds: np.ndarray, gram: int, size: int) -> tuple[np.ndarray, ...]:
    """(text, p0, p1, q, h) of each anchor; places count from the text's begin."""
    longest = 1 << 22
    if len(units) >= longest + size and len(bounds) == 2:  # one very long text: by overlapping segments
        out = [anchors(units[s : s + longest + size - 1], np.array([0, min(longest + size - 1, len(units) - s)]), gram, size) for s in range(0, len(units) - size + 1, longest)]
        moved = [(t, p0 + s * longest, p1 + s * longest, q + s * longest, h) for s, (t, p0, p1, q, h) in enumerate(out)]
        return tuple(np.concatenate(x) for x in zip(*moved, strict=True))
    n = len(units)
    if n < size:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    key = Rolling(units).all(gram)
    low = (key & ~_LOW) | np.arange(len(key), dtype=np.uint64)
    span, width = 1, size - gram + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    p = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    q = (low[p] & _LOW).astype(np.int64)
    new = np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)][: len(p)]
    p0, p1, q = p[new], p[np.r_[new[1:], True][: len(p)]], q[new]
    text = text[p0].astype(np.int64)
    base = bounds[text]
    return text, p0 - base, p1 - base, q - base, key[q]


def merged(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that touch or overlap within one id become one."""
    if not len(ids):
        return ids, start, end
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    change = np.r_[True, ids[1:] != ids[:-1]]
    group = np.cumsum(change) - 1
    wide = (end.max() if len(end) else 0) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    new = change | np.r_[True, start[1:] > reach[:-1]]
    last = np.r_[new[1:], True]
    return ids[new], start[new], reach[last]


def merged_rows(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """``merged`` for rows with an id and a fold: ids, folds, starts, ends."""
    order = np.lexsort((rows["fold"], rows["id"]))
    same = rows[order]
    new = np.r_[True, (same["id"][1:] != same["id"][:-1]) | (same["fold"][1:] != same["fold"][:-1])][: len(rows)]
    row = np.empty(len(rows), np.int64)
    row[order] = np.cumsum(new) - 1
    names = same[new]
    k, a, b = merged(row, start, end)
    return names["id"][k], names["fold"][k], a, b


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the runs of an array between ``bounds``."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def unpacked(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """id, fold and text of each row: what a row is known by, and whole texts."""
    return docs.select(*more, doc_key().alias("id"), fold().alias("fold"), whole_text().alias("text"))


ANCHORS = "h long, salt long, split boolean, places binary"


def by_anchor(h: np.ndarray, places: np.ndarray, per_block: int) -> pa.RecordBatch:
    """One row per anchor of a task. Blocks that the task fills have a salt; the
    rest of such an anchor, which may be nothing, is ``split`` and meets that of
    other tasks under salt 0.
    """
    order = np.argsort(h, kind="stable")
    h, places = h[order], places[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.diff(np.r_[at, len(h)])
    pieces = np.where(n > per_block, n // per_block + 1, 1)  # the rest, then full blocks
    g = np.repeat(np.arange(len(at)), pieces)
    j = np.arange(len(g)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = at[g] + np.where(j > 0, n[g] % per_block + (j - 1) * per_block, 0)
    first = places[np.minimum(starts, len(places) - 1)]
    salt = mix(first["id"].view(np.uint64) ^ mix(first["fold"].view(np.uint64) + first["p0"].astype(np.uint64))) | np.uint64(1)
    return pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(np.where(j > 0, salt, np.uint64(0)).view(np.int64)), pa.array(pieces[g] > 1), binaries(places, np.r_[starts, len(h)])], names=["h", "salt", "split", "places"])


def scan(docs: DataFrame, units: Callable, gram: int, size: int, per_block: int = PER_BLOCK) -> DataFrame:
    """h, salt, split, places: the packed places of each anchor within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids, folds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for a, b, texts in slices(batch, 2):
                made, bounds = units(texts)
                text, p0, p1, q, h = anchors(made, bounds, gram, size)
                places = np.empty(len(h), PLACE)
                for name, x in (("id", ids[a:b][text]), ("fold", folds[a:b][text]), ("p0", p0), ("p1", p1), ("q", q)):
                    places[name] = x
                held.append((h, places))
                rows += len(h)
                if rows >= MERGE_ROWS:
                    yield by_anchor(*(np.concatenate(x) for x in zip(*held, strict=True)), per_block)
                    held, rows = [], 0
        if rows:
            yield by_anchor(*(np.concatenate(x) for x in zip(*held, strict=True)), per_block)

    return keyed(docs).mapInArrow(run, ANCHORS)


def repeated(rows: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """id, fold, mark (packed): the places of all anchors that occur again, dealt to blocks.

    Rows arrive sorted by anchor; of an anchor's places a task holds a few
    blocks at most.
    """

    def marks(h: np.ndarray, salt: np.ndarray, split: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        out = np.empty(len(places), MARK)
        for name, x in (("h", h), ("salt", salt), ("split", split)):
            out[name] = x
        for name in ("p0", "p1", "q"):
            out[name] = places[name]
        return pa.RecordBatch.from_arrays([pa.array(places["id"]), pa.array(places["fold"]), binaries(out, np.arange(len(out) + 1))], names=["id", "fold", "mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, salt, split, n, places = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, PLACE)
        dealt = 0  # places of the first group that went out already

        def settle(groups: np.ndarray, upto: int) -> pa.RecordBatch | None:
            """The first ``upto`` groups, whole."""
            if not upto:
                return None
            rows = int(groups[upto])
            total = np.add.reduceat(n[:rows], groups[:upto])
            parted = np.logical_or.reduceat(split[:rows], groups[:upto])
            before = np.zeros(upto, np.int64)
            before[0] = dealt
            parted |= (total > per_block) | (before > 0)
            keep = (total > 1) | parted
            of = np.repeat(np.arange(upto), total)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(total) - total, total) + before[of]
            use = np.flatnonzero(keep[of])
            of, inside = of[use], inside[use]
            if not len(use):
                return None
            block = salt[groups[:upto]][of] + np.where(salt[groups[:upto]][of] == 0, inside // per_block, 0)
            return marks(h[groups[:upto]][of], block, parted[of], places[: int(n[:rows].sum())][use])

        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(new[0]):
                continue
            data = batch.column(3)
            h, salt, split = (np.concatenate(x) for x in zip((h, salt, split), new, strict=True))
            n = np.r_[n, pc.binary_length(data).to_numpy(zero_copy_only=False) // PLACE.itemsize]
            places = np.concatenate([places, unpacked(data, PLACE)])
            groups = np.r_[np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]), len(h)]
            made = settle(groups, len(groups) - 2)  # the last group may go on
            if made is not None:
                yield made
            if len(groups) > 2:
                dealt, rows = 0, int(groups[-2])
                places = places[int(n[:rows].sum()) :]
                h, salt, split, n = (x[rows:] for x in (h, salt, split, n))
            if (more := len(places) // per_block * per_block) >= 4 * per_block:
                yield marks(np.full(more, h[0]), salt[0] + (dealt + np.arange(more)) // per_block, np.ones(more, bool), places[:more])
                dealt += more
                h, salt, split, n, places = h[:1], salt[:1], np.ones(1, bool), np.array([len(places) - more]), places[more:]
        if len(h):
            made = settle(np.array([0, len(h)]), 1)
            if made is not None:
                yield made

    parts = shuffle_parts(rows.sparkSession)
    return rows.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(run, "id long, fold long, mark binary")


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """id, fold, text and ``marks``, the packed places of repeated anchors in each text that has any."""
    lists = marks.groupBy("id", "fold").agg(F.collect_set("mark").alias("marks"))
    return keyed(docs).join(lists.hint("shuffle_hash"), ["id", "fold"]).select("id", "fold", "text", "marks")


def marked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray]]:
    """First row, texts, marks and the row of each mark, for slices of a batch of ``with_marks``."""
    lists = batch.column(3).to_pylist()
    for a, b, texts in slices(batch, 2):
        made = np.frombuffer(b"".join(x for i in range(a, b) for x in lists[i]), MARK)
        yield a, texts, made, np.repeat(np.arange(a, b), [len(lists[i]) for i in range(a, b)])


RUNS = "w1 long, w2 long, id long, fold long, start int, end int"


def run_rows(w1, w2, ids, folds, start, end) -> pa.RecordBatch:
    """A batch of runs [start, end); those of blocks that must meet again have their string's hash and end before 0."""
    i32 = lambda x: pa.array(np.asarray(x).astype(np.int32))
    i64 = lambda x: pa.array(np.asarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([i64(w1), i64(w2), pa.array(ids), pa.array(folds), i32(start), i32(end)], names=["w1", "w2", "id", "fold", "start", "end"])


def finish(docs: DataFrame, runs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over (doc_id, text, starts, ends) batches; runs as lists, null where there are none."""
    lists = runs.groupBy("id", "fold").agg(F.collect_set(F.struct("start", "end")).alias("runs")).select("id", "fold", F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends"))
    joined = keyed(docs, "doc_id").join(lists.hint("shuffle_hash"), ["id", "fold"], "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(run, schema)


def per_text(batch: pa.RecordBatch, col: int) -> list[np.ndarray]:
    """A list column as one array per row."""
    return [np.array(x or [], np.int64) for x in batch.column(col).to_pylist()]


def cover(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged runs of one text."""
    _, a, b = merged(np.zeros(len(starts), np.int64), starts, ends)
    return a, b
