"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Terms are hashed words, word shapes (capitals, letters, digits, trailing marks)
and repeats of the words before. Document counts over all texts give the IDF;
a randomised SVD of the labelled sample gives the latent space. The labelled
vectors are broadcast, every document's cosines with all of them are computed in
blocks, and its nearest neighbours vote with weights that grow with similarity.

Only the labelled sample is bounded (PER_CLASS rows of each label, a megabyte
of vectors). A text without terms gets the sample's mean label. Null texts count
as empty. Repeated rows are scored each; of several labels of one doc_id the
smallest counts, and equal labelled rows are learned from once. Of neighbours
with equal cosines those first in the sample's order (a hash of doc_id, then of
the text) vote. Texts over PIECE bytes are counted in pieces, which may cut a
word and the repeats across the cut. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text
from .labelled import first_of_each, held_out, sample_rows
from .terms import document_counts, words
from .windows import mix

WORDS, SHAPES = 3072, 1024
DIMENSIONS = WORDS + SHAPES
PER_CLASS = 1500
RANK = 64
NEIGHBOURS = 21
PIECE = 4 << 20
THRESHOLD = 0.7
_CLASS = np.zeros(256, np.uint64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_CLASS[[33, 46, 44, 63, 58, 59]] = 4


def counts(texts: list[bytes]) -> np.ndarray:
    """Texts by dimensions: how often each hashed term occurs."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        return sum(counts([texts[0][k : k + PIECE]]) for k in range(0, len(texts[0]), PIECE))
    data, start, end, hashes, doc = words(texts)
    n = len(texts) * DIMENSIONS
    if not len(start):
        return np.zeros((len(texts), DIMENSIONS), np.float32)
    kinds = _CLASS[data]
    size = end - start
    shape = np.zeros(len(start), np.uint64)
    for place in (start, np.minimum(start + 1, end - 1), np.maximum(end - 3, start), np.maximum(end - 2, start), end - 1):
        mark = np.where(kinds[place] == 0, data[place].astype(np.uint64) + np.uint64(16), kinds[place])
        shape = shape * np.uint64(293) + mark
    shape = shape * np.uint64(7) + np.minimum(size // 4, 5).astype(np.uint64)
    repeat = np.zeros(len(start), np.uint64)
    for back in (1, 2, 3):
        same = (hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back])
        repeat[back:][same] = back
    again = np.flatnonzero(repeat)
    base = doc * DIMENSIONS
    cells = [base + (hashes % np.uint64(WORDS)).astype(np.int64), base + WORDS + (mix(shape) % np.uint64(SHAPES - 8)).astype(np.int64), base[again] + (DIMENSIONS - 8 + repeat[again].astype(np.int64))]
    return np.bincount(np.concatenate(cells), minlength=n).reshape(len(texts), DIMENSIONS).astype(np.float32)


def blocks(texts: list[bytes], rows: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    for k in range(0, len(texts), rows):
        yield k, texts[k : k + rows]


def present(texts: list[bytes]) -> tuple[np.ndarray, int]:
    total = np.zeros(DIMENSIONS, np.int64)
    for _, part in blocks(texts):
        total += (counts(part) > 0).sum(0)
    return total, len(texts)


class Space:
    """TF-IDF weights and the latent basis."""

    def __init__(self, idf: np.ndarray) -> None:
        self.idf, self.basis = idf.astype(np.float32), None

    def weigh(self, tf: np.ndarray) -> np.ndarray:
        """Damped TF-IDF; words and shapes each carry half of a row's length."""
        x = np.log1p(tf) * self.idf
        for part in (x[:, :WORDS], x[:, WORDS:]):
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        return x

    def latent(self, tf: np.ndarray) -> np.ndarray:
        z = self.weigh(tf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def randomised_svd(x: np.ndarray, rank: int, rounds: int = 4, seed: int = 0) -> np.ndarray:
    """The leading right singular vectors of x, as columns."""
    rng = np.random.default_rng(seed)
    y = rng.standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        y = np.linalg.qr(x.T @ (x @ y))[0]
    _, _, v = np.linalg.svd(x @ y, full_matrices=False)
    return (y @ v.T)[:, :rank]


def nearest(cos: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n largest values of each row; of equal ones the first."""
    least = np.partition(cos, cos.shape[1] - n, axis=1)[:, cos.shape[1] - n, None]
    more, equal = cos > least, cos == least
    room = n - more.sum(1, keepdims=True)
    tied = equal.sum(1) > room[:, 0]
    if tied.any():
        equal[tied] &= np.cumsum(equal[tied], axis=1) <= room[tied]
    return np.nonzero(more | equal)[1].reshape(len(cos), n)


class Model:
    def __init__(self, space: Space, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.space, self.vectors, self.labels = space, vectors, labels

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), float(self.labels.mean()))
        for k, part in blocks(texts):
            tf = counts(part)
            some = np.flatnonzero(tf.any(1))
            if not len(some):
                continue
            cos = self.space.latent(tf[some]) @ self.vectors.T
            near = nearest(cos, min(NEIGHBOURS, cos.shape[1]))
            weight = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** 4
            out[k + some] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from labelled rows outside the held-out fold."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    picked = sample_rows(marks.select(F.col("label_id").alias("doc_id"), "quality").where(~held_out()), "quality", PER_CLASS, 2)
    bound = picked.orderBy("order", "doc_id").limit(4 * PER_CLASS).select(F.col("doc_id").alias("label_id"), "quality", "order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch, 3):
                for k, part in blocks(texts):
                    tf = counts(part)
                    terms = [np.flatnonzero(row) for row in tf]
                    cells = [pa.array([x.astype(dtype).tobytes() for x in xs], pa.binary()) for dtype, xs in (("<u2", terms), ("<u4", [row[t] for row, t in zip(tf, terms, strict=True)]))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a + k, len(part)) for c in range(3)), *cells], names=["quality", "order", "tie", "terms", "counts"])

    joined = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(bound), F.col("doc_id") == F.col("label_id"))
    each = joined.select("quality", "order", F.xxhash64("text").alias("tie"), "text").dropDuplicates(["quality", "order", "tie"])
    made = each.mapInArrow(run, "quality int, order long, tie long, terms binary, counts binary")
    got = first_of_each(made.orderBy("order", "tie").limit(2 * PER_CLASS + PER_CLASS // 2).collect(), "quality", PER_CLASS)
    if not got:
        return None
    n, df = document_counts(docs, present, DIMENSIONS)
    space = Space(np.log((1 + n) / (1 + df)) + 0.1)
    tf = np.zeros((len(got), DIMENSIONS), np.float32)
    for row, r in zip(tf, got, strict=True):
        row[np.frombuffer(r["terms"], "<u2")] = np.frombuffer(r["counts"], "<u4")
    space.basis = randomised_svd(space.weigh(tf), RANK).astype(np.float32)
    return Model(space, space.latent(tf).astype(np.float32), np.array([r["quality"] for r in got], float))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch, 2):
                score = np.clip(model.score(texts), 0, 1) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
