"""Language ID with string kernels, Nyström landmarks and ridge regression.

A text's features say which byte n-grams (one to four, blended) occur in it; the
kernel of two texts is the share of n-grams that both have. Landmarks stand in
for the training texts (Nyström), one ridge regression per language is fitted
against the rest, and whole texts are scored by matrix products per batch. The
n-grams are hashed to DIMENSIONS cells. Very long texts are read in segments.

Training rows are a bounded sample of SAMPLE rows: PER_LANGUAGE of each
language, fewer where there are many languages, repeated rows once. Every language is learned; more
languages than SAMPLE are an error. Everything else sees every row. Null and
letterless texts are ``und`` with score 0. Repeated rows are scored each. Equal
scores go to the language that sorts first. Without any labelled row all texts
are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled import first_of_each, held_out, sample_rows

BITS = 16
DIMENSIONS = 1 << BITS
ORDERS = (1, 2, 3, 4)
#: Bounds of the training sample and of the landmarks.
PER_LANGUAGE, SAMPLE, LANDMARKS = 500, 8_000, 160
RIDGE = 1e-3
UNKNOWN = "und"
#: Bytes of a text that are read at once, and texts whose features are held at once.
SEGMENT, ROWS = 1 << 20, 64
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def _mark(out: np.ndarray, texts: list[bytes]) -> None:
    """Set the cells of the texts' n-grams; ``out`` is flat, a row of DIMENSIONS per text."""
    n = np.array([len(t) for t in texts], np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    row = np.repeat(np.arange(len(texts), dtype=np.int32) * DIMENSIONS, n)
    left = (np.repeat(np.cumsum(n), n) - np.arange(len(data))).astype(np.int32)  # bytes to the text's end
    gram = np.zeros(len(data), np.uint32)
    for k in ORDERS:
        gram = gram[: len(data) - k + 1] * np.uint32(257) + data[k - 1 :]
        if not len(gram):
            break
        cell = ((gram * np.uint32(2654435761)) ^ np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        inside = left[: len(gram)] >= k
        at = row[: len(gram)] + cell.astype(np.int32)
        out[at if inside.all() else at[inside]] = True


def presence(texts: list[bytes]) -> np.ndarray:
    """Texts by dimensions, true where a hashed n-gram occurs."""
    out = np.zeros((len(texts), DIMENSIONS), bool)
    if all(len(t) <= SEGMENT for t in texts):
        _mark(out.reshape(-1), texts)
        return out
    for row, text in zip(out, texts, strict=True):
        for at in range(0, len(text), SEGMENT):
            _mark(row, [text[at : at + SEGMENT + ORDERS[-1] - 1]])
    return out


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(x.sum(1, dtype=np.float32), 1))[:, None]


class Model:
    """Landmarks and their weights, multiplied out to one column of cell weights per language."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.languages = languages
        self.table = ((landmarks / _lengths(landmarks)).T @ weights).astype(np.float32)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probability-like score of the best language of each row."""
        out = x.astype(np.float32) @ self.table / _lengths(x)
        soft = np.exp(4 * (out - out.max(1, keepdims=True)))
        return out.argmax(1), soft.max(1) / soft.sum(1)


def fit(rows: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on Nyström features; ``rows`` are packed presences."""
    unpack = lambda some: np.stack([np.unpackbits(np.frombuffer(r, np.uint8)) for r in some]).astype(np.float32)
    languages = sorted(set(labels))
    by = {lang: [i for i, v in enumerate(labels) if v == lang] for lang in languages}
    chosen = sorted(i for some in by.values() for i in some[: max(1, landmarks // len(languages))])
    marks = unpack([rows[i] for i in chosen])
    marks /= _lengths(marks)
    kernel = []
    for k in range(0, len(rows), ROWS):
        x = unpack(rows[k : k + ROWS])
        kernel.append((x @ marks.T / _lengths(x)).astype(np.float64))
    kernel = np.concatenate(kernel)
    values, vectors = np.linalg.eigh(kernel[chosen])
    strong = values > 1e-6 * values[-1]
    root = vectors[:, strong] / np.sqrt(values[strong])
    z = kernel @ root
    y = np.array([[1.0 if v == lang else -1.0 for lang in languages] for v in labels])
    weight = np.array([1 / len(by[v]) for v in labels])[:, None]
    beta = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (y * weight))
    return Model(languages, unpack([rows[i] for i in chosen]), (root @ beta).astype(np.float32))


def learn(docs: DataFrame) -> Model | None:
    """A model from rows outside the held-out fold with a label."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    languages = rows.select("lang").distinct().limit(SAMPLE + 1).count()
    if languages > SAMPLE:
        raise ValueError(f"the documents have labels of more than {SAMPLE} languages")
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    picked = sample_rows(rows, "lang", each, SAMPLE, ("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch, 3):
                for k in range(0, len(texts), ROWS):
                    bits = [np.packbits(row).tobytes() for row in presence(texts[k : k + ROWS])]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a + k, len(bits)) for c in range(3)), pa.array(bits, pa.binary())], names=["lang", "order", "tie", "bits"])

    chosen = picked.select("lang", "order", F.xxhash64("text").alias("tie"), "text").dropDuplicates(["lang", "order", "tie"]).mapInArrow(run, "lang string, order long, tie long, bits binary")
    # a language has about 1.2 * each rows at most, so the limit cuts none
    got = first_of_each(chosen.orderBy("order", "tie").limit(2 * each * max(1, languages)).collect(), "lang", each)
    return fit([bytes(r["bits"]) for r in got], [r["lang"] for r in got]) if got else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch, 2):
                lang, score = np.array([UNKNOWN] * len(texts), object), np.zeros(len(texts))
                known = np.flatnonzero([model is not None and has_letter(t) for t in texts])
                for k in range(0, len(known), ROWS):
                    part = known[k : k + ROWS]
                    best, sure = model.score(presence([texts[i] for i in part]))
                    lang[part], score[part] = np.array(model.languages, object)[best], sure
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


