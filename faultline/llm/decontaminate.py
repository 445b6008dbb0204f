"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words, weighted by TF-IDF over
hashed terms; the IDF counts every document. One distributed pass sums the
sketch of a randomised SVD over all passages, together with the benchmark's own
passages, which are weighted to carry as much of the total as the corpus. In the
latent space every passage meets every benchmark passage in blocked products.
Copies are also looked up by runs of GRAM words, so they are candidates whatever
their cosine. All candidates are compared word by word: the longest common
subsequence must cover most of the benchmark passage, or, for paraphrases, a
good part of it with the words of its answer (its last line or sentence). An
item of one sentence has no answer apart; there the good part is enough.

The benchmark's texts are checked to be at most MOST_BYTES, for the driver cuts
them into passages. Tasks get them in blocks of PASSAGES, each of which reads the
documents once more. Null and empty texts hold nothing. Very long texts are read
whole, alone in their step. A null doc_id is reported as null; rows that share a
doc_id and an item are reported once, by their best match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, doc_key, fold, shuffle_parts, slices, whole_text, without_rows
from .terms import document_counts, words

DIMENSIONS = 1 << 12
#: Words of half a passage; passages overlap by half.
HALF = 16
#: Words of a benchmark passage at most; longer items are cut.
ITEM_WORDS = 64
#: The rank grows with the square root of the benchmark's passages within these bounds.
RANK, MOST_RANK, OVERSAMPLE = 128, 1024, 8
#: Words of the runs that copies are looked up by; shorter passages are looked up whole.
GRAM = 3
COSINE = 0.2
#: Shares of a benchmark passage that a copy and a paraphrase keep in order.
COPIED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.8
#: Passages under so many words must be there whole.
SHORT = 8
#: Bytes of a benchmark's texts, and passages that a task searches at once.
MOST_BYTES, PASSAGES = 64 << 20, 4_096
#: A benchmark passage: item_id, its words' hashes, and those of its item's answer, if it has one apart.
Passage = tuple[int, np.ndarray, set[int]]


def _dims(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % DIMENSIONS


def present(texts: list[bytes]) -> tuple[np.ndarray, int]:
    _, _, _, hashes, doc = words(texts, bare=True)
    total = np.zeros(DIMENSIONS, np.int64)
    dims = _dims(hashes)
    for k in range(0, len(texts), 512):
        a, b = np.searchsorted(doc, [k, k + 512])
        seen = np.zeros((512, DIMENSIONS), bool)
        seen[doc[a:b] - k, dims[a:b]] = True
        total += seen.sum(0)
    return total, len(texts)


def _runs(doc: np.ndarray, dims: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of HALF words, never across texts, and a row of terms for each.

    Rows of short runs end in the term DIMENSIONS, which no text has.
    """
    n = np.bincount(doc, minlength=texts)
    runs = -(-n // HALF)
    inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(np.cumsum(n) - n, runs) + inside * HALF
    left = np.repeat(n, runs) - inside * HALF
    at = np.minimum(starts[:, None] + np.arange(HALF), len(dims) - 1)
    return starts, np.where(np.arange(HALF) < left[:, None], dims[at], DIMENSIONS)


def _summed(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of table rows, a cache-sized block at a time."""
    out = np.zeros((len(rows), table.shape[1]), np.float32)
    for k in range(0, len(rows), 512):
        part = out[k : k + 512]
        for column in rows[k : k + 512].T:
            part += table[column]
    return out


def _padded(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])


def sketch(texts: list[bytes], idf: np.ndarray, omega: np.ndarray, into: np.ndarray) -> int:
    """Add A^T A omega to ``into``, A the texts' runs of HALF words; the number of runs.

    ``idf`` and ``omega`` are padded, and omega's rows already weighted by IDF.
    """
    _, _, _, hashes, doc = words(texts, bare=True)
    if not len(doc):
        return 0
    _, rows = _runs(doc, _dims(hashes), len(texts))
    square = (idf[rows] ** 2).sum(1)
    y = _summed(omega, rows) / np.maximum(square, 1e-9)[:, None]
    flat = rows.ravel().astype(np.int16)
    order = np.argsort(flat, kind="stable")
    flat, run = flat[order], order // HALF
    cuts = np.r_[np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]), len(flat)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        term = flat[a]
        if term < DIMENSIONS:
            into[term] += idf[term] * y[run[a:b]].sum(0)
    return len(rows)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words; runs across texts are for the caller to leave out."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return out


class Grams:
    """Passages by their runs of n words.

    A copy that lost or changed up to a share 1 - COPIED of a passage's words
    keeps ``least`` runs. Only the rarest runs are held, so many that such a copy
    keeps two of them, or its only one.
    """

    def __init__(self, passages: list[tuple[int, np.ndarray]], n: int) -> None:
        self.n = n
        made = [_grams(w, n) for _, w in passages]
        every, count = np.unique(np.concatenate(made), return_counts=True)
        self.need = np.zeros(1 + max(p for p, _ in passages), np.int64)
        keys, names = [], []
        for (p, w), g in zip(passages, made, strict=True):
            size = len(w)
            edits = size - int(np.ceil(COPIED * size - 1e-9)) if size >= SHORT else 0
            least = max(1, len(g) - n * edits)
            self.need[p] = min(2, least)
            rarest = np.lexsort((g, count[np.searchsorted(every, g)]))[: len(g) - least + self.need[p]]
            keys.append(np.unique(g[rarest]))
            names.append(np.full(len(keys[-1]), p))
        key, name = np.concatenate(keys), np.concatenate(names)
        order = np.argsort(key, kind="stable")
        self.passage = name[order]
        self.keys, self.at = np.unique(key[order], return_index=True)
        self.at = np.r_[self.at, len(key)]
        self.shift = np.uint64(64 - min(24, max(12, int(len(self.keys) * 16).bit_length())))
        self.seen = np.zeros(1 << 64 - int(self.shift), bool)
        self.seen[(self.keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift] = True

    def find(self, hashes: np.ndarray, doc: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and passage wherever enough of a passage's runs are near each other."""
        g = _grams(hashes, self.n)
        at = np.flatnonzero(self.seen[(g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift])
        at = at[doc[at] == doc[at + self.n - 1]]
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        at, k = at[self.keys[k] == g[at]], k[self.keys[k] == g[at]]
        many = self.at[k + 1] - self.at[k]
        word = np.repeat(at, many)
        p = self.passage[np.repeat(self.at[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        order = np.lexsort((word, p))
        word, p = word[order], p[order]
        after = np.minimum(np.arange(len(p)) + self.need[p] - 1, len(p) - 1)
        reach = size[p] + size[p] // 2 + 1
        near = (p[after] == p) & (doc[word[after]] == doc[word]) & (word[after] - word < reach)
        near &= after == np.arange(len(p)) + self.need[p] - 1
        return word[near], p[near]


def passages_of(items: list[tuple[int, str]]) -> list[Passage]:
    """The items' words in passages of at most ITEM_WORDS, with their answers."""
    out = []
    for item, text in items:
        _, _, _, hashes, _ = words([text.encode()], bare=True)
        lines = [x for x in re.split(r"\n|(?<=[.!?])\s", text.strip()) if x.strip()]
        answer = set(words([lines[-1].encode()], bare=True)[3].tolist()) if len(lines) > 1 else set()
        for part in np.array_split(hashes, -(-len(hashes) // ITEM_WORDS)) if len(hashes) else []:
            out.append((item, part, answer))
    return out


class Query:
    """Benchmark passages: words, term sets and answers."""

    def __init__(self, passages: list[Passage]) -> None:
        self.item, self.words, self.answer = ([p[k] for p in passages] for k in range(3))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.least = least_hits(self.size)
        self.terms = np.zeros((len(self.words), DIMENSIONS + 1), bool)
        self.bits, self.count = [], []
        for k, w in enumerate(self.words):
            self.terms[k, _dims(w)] = True
            bits: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                bits[x] = bits.get(x, 0) | 1 << i
            self.bits.append(bits)
            self.count.append({x: v.bit_count() for x, v in bits.items()})

        by = {n: [(k, w) for k, w in enumerate(self.words) if min(len(w), GRAM) == n] for n in range(1, GRAM + 1)}
        self.grams = [Grams(some, n) for n, some in by.items() if some]


def weighted(passages: list[Passage], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of benchmark passages, of length one."""
    out = np.zeros((len(passages), DIMENSIONS), np.float32)
    for row, (_, w, _) in zip(out, passages, strict=True):
        np.add.at(row, _dims(w), idf[_dims(w)])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def basis(sketched: np.ndarray, omega: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors from y = A^T A omega (one pass)."""
    q = np.linalg.qr(sketched)[0]
    core = np.linalg.lstsq((q.T @ omega).T, (q.T @ sketched).T, rcond=1e-6)[0].T
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def common_subsequence(bits: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence; ``bits`` has each word's places in the n words."""
    full = (1 << n) - 1
    v = full
    for w in other:
        u = v & bits.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def least_kept(size: np.ndarray) -> np.ndarray:
    """Words of a passage of ``size`` words that are found in order at least, wherever it is accepted."""
    return np.where(size < SHORT, size, np.ceil(PARAPHRASED * size - 1e-9)).astype(np.int64)


def least_hits(size: np.ndarray) -> np.ndarray:
    """Words of a passage of ``size`` words that the best of the windows over it has at least, wherever it is accepted.

    It is found within 1.5 times its length. So many words touch a bounded number
    of runs, and of the pairs of adjacent runs that cover them one has its share.
    """
    runs = (size + size // 2 - 1) // HALF + 2
    return -(-least_kept(size) // -(-runs // 2))


def best_overlap(bits: dict[int, int], n: int, region: list[int]) -> tuple[float, int, int]:
    """Best share of n words found in order within 1.5 times their length; where, how long."""
    width = n + n // 2 + 1
    best = (0.0, 0, 0)
    for a in range(0, max(1, len(region) - width + 1 + n // 4), max(1, n // 4)):
        part = region[a : a + width]
        share = common_subsequence(bits, n, part) / n
        if share > best[0]:
            best = (share, a, len(part))
    return best


class Search:
    """What a task needs to search its documents."""

    def __init__(self, passages: list[Passage], idf: np.ndarray, vectors: np.ndarray) -> None:
        self.query, self.idf = Query(passages), _padded(idf)
        self.table = _padded((vectors * idf[:, None]).astype(np.float32))
        z = np.concatenate([weighted(passages[k : k + 512], idf) @ vectors for k in range(0, len(passages), 512)])
        self.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def candidates(self, dims: np.ndarray, hashes: np.ndarray, doc: np.ndarray, texts: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(first word, end, passage, cosine) of pairs above the cosine that share enough terms, and of copies."""
        starts, rows = _runs(doc, dims, texts)
        half = _summed(self.table, rows)
        energy = (self.idf[rows] ** 2).sum(1)
        size = (rows < DIMENSIONS).sum(1)
        owner = doc[starts]
        joined = np.r_[owner[1:] == owner[:-1], False]
        alone = ~joined & np.r_[True, owner[1:] != owner[:-1]]
        first = np.flatnonzero(joined | alone)  # a passage is two runs, or a text's only one
        second = np.where(joined[first], first + 1, -1)
        half, energy, size = _padded(half), _padded(energy), _padded(size)
        rows = np.concatenate([rows, np.full((1, HALF), DIMENSIONS)])
        terms = self.query.terms.ravel()
        for k in range(0, len(first), 4_096):
            a, b = first[k : k + 4_096], second[k : k + 4_096]
            norm = np.sqrt(np.maximum(energy[a] + energy[b], 1e-9))
            cos = ((half[a] + half[b]) / norm[:, None]) @ self.vectors.T
            at = np.flatnonzero(cos.ravel() >= COSINE)
            if not len(at):
                continue
            w, p = at // cos.shape[1], at % cos.shape[1]
            n = size[a[w]] + size[b[w]]
            hits = np.zeros(len(w), np.int64)
            for part in (a, b):
                hits += np.count_nonzero(terms.take(rows[part[w]] + p[:, None] * (DIMENSIONS + 1)), axis=1)
            enough = hits >= self.query.least[p]
            w, p, n, c = w[enough], p[enough], n[enough], cos.ravel()[at][enough]
            yield starts[a[w]], starts[a[w]] + n, p, c
        for grams in self.query.grams:
            word, p = grams.find(hashes, doc, self.query.size)
            # the window whose first run has the word, or whose second where no window begins with it
            w = np.searchsorted(first, np.searchsorted(starts, word, "right") - 1, "right") - 1
            w, p = np.unique(np.stack([w, p], axis=1), axis=0).T if len(w) else (w, p)
            for k in range(0, len(w), 4_096):
                a, b, q = first[w[k : k + 4_096]], second[w[k : k + 4_096]], p[k : k + 4_096]
                norm = np.sqrt(np.maximum(energy[a] + energy[b], 1e-9))
                yield starts[a], starts[a] + size[a] + size[b], q, ((half[a] + half[b]) / norm[:, None] * self.vectors[q]).sum(1)

    def dense(self, a: np.ndarray, p: np.ndarray, dims: np.ndarray) -> np.ndarray:
        """Whether somewhere near the window at ``a`` 1.5 times the passage's length holds enough of its terms."""
        out = np.zeros(len(a), bool)
        margin = int(self.query.size.max()) * 2 + 2 * HALF
        around = np.full(len(dims) + 2 * margin, DIMENSIONS, np.int32)  # words of texts before and after only let more through
        around[margin : margin + len(dims)] = dims
        terms = self.query.terms.ravel()
        order = np.argsort(self.query.size[p], kind="stable")
        size = self.query.size[p[order]]
        cuts = np.r_[np.flatnonzero(np.r_[True, size[1:] != size[:-1]]), len(size)]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = int(size[s])
            width, least = n + n // 2 + 1, int(least_kept(size[s]))
            for k in range(s, e, 4_096):
                some = order[k : min(e, k + 4_096)]
                near = around[a[some, None] + np.arange(margin - width, margin + 2 * HALF + width)]
                hits = terms.take(near + p[some, None] * (DIMENSIONS + 1))
                total = np.cumsum(hits, axis=1, dtype=np.int16)
                out[some] = (total[:, width:] - total[:, :-width]).max(1) >= least
        return out

    def matches(self, texts: list[bytes]) -> Iterator[tuple]:
        """(text, item, first word, words, cosine, overlap, answered)."""
        _, _, _, hashes, doc = words(texts, bare=True)
        if not len(doc):
            return
        dims = _dims(hashes)
        found = [np.concatenate(x) for x in zip(*self.candidates(dims, hashes, doc, len(texts)), strict=True)]
        if not found or not len(found[0]):
            return
        near = self.dense(found[0], found[2], dims)
        found = [x[near] for x in found]
        if not len(found[0]):
            return
        order = np.lexsort((found[0], found[2], doc[found[0]]))
        a, b, p, cos = (x[order] for x in found)
        owner = doc[a]
        new = np.r_[True, (owner[1:] != owner[:-1]) | (p[1:] != p[:-1]) | (a[1:] > b[:-1] + HALF)]
        cuts = np.r_[np.flatnonzero(new), len(a)]
        first, last = np.searchsorted(doc, np.arange(len(texts)), "left"), np.searchsorted(doc, np.arange(len(texts)), "right")
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            d, k = int(owner[s]), int(p[s])
            size = int(self.query.size[k])
            reach = size + size // 2 + 1
            lo, hi = max(first[d], a[s] - reach), min(last[d], b[s:e].max() + reach)
            region = hashes[lo:hi].tolist()
            count = self.query.count[k]
            if sum(count[x] for x in count.keys() & set(region)) < PARAPHRASED * size:
                continue  # no order of these words could be enough
            share, at, length = best_overlap(self.query.bits[k], size, region)
            answer = self.query.answer[k]
            answered = bool(answer) and len(answer & set(region[at : at + length])) >= ANSWERED * len(answer)
            if share == 1 or size >= SHORT and (share >= COPIED or share >= PARAPHRASED and (answered or not answer)):
                yield d, self.query.item[k], int(lo - first[d]) + at, length, float(cos[s:e].max()), share, answered


_SCHEMA = "doc_id long, fold long, item_id long, at long, n_words long, cosine double, overlap double, answered boolean"


def _sketch_all(docs: DataFrame, idf: np.ndarray, omega: np.ndarray) -> tuple[int, np.ndarray]:
    """Passages of the corpus and the summed sketch, one row per term and task shuffled."""
    padded, weighted = _padded(idf), _padded(omega * idf[:, None])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into, n = np.zeros_like(omega), 0
        for batch in batches:
            for _, _, texts in slices(batch, 0, 4 * CHUNK_BYTES):
                n += sketch(texts, padded, weighted, into)
        some = np.flatnonzero(into.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([into[k].tobytes() for k in some], pa.binary())], names=["term", "row"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.float64(n).tobytes()], pa.binary())], names=["term", "row"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for term, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(row, np.float64 if term < 0 else np.float32)
                sums[term] = sums[term] + x if term in sums else x.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["term", "row"])

    made = docs.select(whole_text().alias("text")).mapInArrow(part, "term int, row binary")
    rows = made.repartition(shuffle_parts(docs.sparkSession), "term").mapInArrow(total, "term int, row binary").collect()
    out, n = np.zeros(omega.shape), 0
    for r in rows:
        x = np.frombuffer(r["row"], np.float64)
        if r["term"] < 0:
            n = int(x[0])
        else:
            out[r["term"]] = x
    return n, out


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every match: doc_id and fold of the row, item_id, at, n_words, cosine, overlap, answered."""
    spark = docs.sparkSession
    texts = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    size = texts.agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()[0]["n"] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes, more than {MOST_BYTES}; search it in several calls")
    passages = passages_of([(r["item_id"], r["text"]) for r in texts.collect()])
    if not passages:
        return spark.createDataFrame([], _SCHEMA)
    n, df = document_counts(docs, present, DIMENSIONS)
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    rank = min(MOST_RANK, max(RANK, int(4 * len(passages) ** 0.5)))
    omega = np.random.default_rng(0).standard_normal((DIMENSIONS, rank + OVERSAMPLE)).astype(np.float32)
    runs, sketched = _sketch_all(docs, idf, omega)
    for k in range(0, len(passages), 512):
        own = weighted(passages[k : k + 512], idf)
        sketched += max(runs, 1) / len(passages) * (own.T @ (own @ omega))
    vectors = basis(sketched, omega, rank)

    def searching(some: list[Passage]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(some, idf, vectors)
            for batch in batches:
                for a, b, texts in slices(batch, 2):
                    got = list(search.matches(texts))
                    if got:
                        doc, *rest = zip(*got, strict=True)
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                        rows = [batch.column(c).slice(a, b - a).take(pa.array(doc)) for c in (0, 1)]
                        yield pa.RecordBatch.from_arrays([*rows, *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], names=["doc_id", "fold", "item_id", "at", "n_words", "cosine", "overlap", "answered"])

        return run

    found = None
    for k in range(0, len(passages), PASSAGES):
        part = docs.select("doc_id", fold().alias("fold"), whole_text().alias("text")).mapInArrow(searching(passages[k : k + PASSAGES]), _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, at, n_words, cosine, overlap, answered: documents that hold benchmark passages."""
    best = F.max(F.struct("overlap", "cosine", -F.col("at"), "n_words", "answered")).alias("best")
    each = search(docs, benchmark).groupBy("doc_id", "item_id").agg(best)
    return each.select("doc_id", "item_id", (-F.col("best.col3")).alias("at"), "best.n_words", "best.cosine", "best.overlap", "best.answered")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage."""
    found = search(docs, benchmark)
    return without_rows(docs, found.select(doc_key().alias("id"), "fold"))
