from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from faultline.llm import decontaminate as d
from faultline.llm import queries

from .fixtures import SCHEMA


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence_matches_the_table():
    rng = random.Random(1)
    for _ in range(100):
        a, b = [rng.randint(0, 5) for _ in range(rng.randint(1, 70))], [rng.randint(0, 5) for _ in range(rng.randint(0, 90))]
        bits: dict[int, int] = {}
        for k, w in enumerate(a):
            bits[w] = bits.get(w, 0) | 1 << k
        assert d.common_subsequence(bits, len(a), b) == lcs(a, b)


def test_basis_spans_the_leading_directions():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 6)) @ np.diag([9, 8, 7, 6, 5, 4]) @ rng.standard_normal((6, 50))
    omega = rng.standard_normal((50, 10))
    v = d.basis(x.T @ (x @ omega), omega, 6)
    assert np.linalg.norm(x - x @ v @ v.T) < 1e-3 * np.linalg.norm(x)


def test_planted_passages_are_found_and_clean_texts_left(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(3, 9))) for _ in range(900)] + ["the", "of", "and"] * 150
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: say(rng.choice([15, 20, 33, 50, 120])) for i in range(30)} | {30: ["only", "four", "words", "here"]}
    rows, truth = [], set()
    for k in range(300):
        words = say(rng.randint(0, 300))
        if k % 6 == 0:
            i = rng.randrange(31)
            part = list(items[i])
            if k % 12 == 0 and len(part) > 20:  # a paraphrase: a tenth of the words change, the answer stays
                for j in rng.sample(range(len(part) - 10), len(part) // 10):
                    part[j] = "changed"
            if k % 18 == 0:
                part = [w.upper() + "!!" for w in part]
            cut = rng.randint(0, len(words))
            words = words[:cut] + part + words[cut:]
            truth.add((k, i))
        rows.append((k, " ".join(words), None, None, None, "", 0, ""))
    rows += [(900, None, None, None, None, "", 0, ""), (901, "", None, None, None, "", 0, ""), (None, " ".join(say(30) + items[0] + say(20)), None, None, None, "", 0, "")]
    truth.add((None, 0))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None), (98, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in queries.op8_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert got == truth
    left = d.clean(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert sorted(r.doc_id for r in left.collect()) == sorted({r[0] for r in rows} - {t[0] for t in truth})


def test_candidates_without_shared_words_match_nothing():
    passages = d.passages_of([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")])
    idf = np.ones(d.DIMENSIONS, np.float32)
    search = d.Search(passages, idf, np.linalg.qr(np.random.default_rng(0).standard_normal((d.DIMENSIONS, 4)))[0])
    search.vectors[:] = 0
    search.table[:] = 0
    old, d.COSINE = d.COSINE, -1.0
    try:
        assert list(search.matches([b"one two three " * 30, b"", b"four"])) == []
    finally:
        d.COSINE = old


def test_no_window_test_rejects_what_the_overlap_accepts():
    idf = np.ones(d.DIMENSIONS, np.float32)
    for n in (8, 20, 33, 40, 47, 64):
        item = [f"item{k}" for k in range(n)]
        size = n + 1
        search = d.Search(d.passages_of([(1, " ".join(item) + ".\n" + item[-1])]), idf, np.zeros((d.DIMENSIONS, 1)))
        search.vectors[:] = 1
        search.table[:-1] = 0.22 / 2 / d.HALF**0.5 / 2**0.5 * 2  # cosine 0.22 of every full window
        lost = size - int(np.ceil(d.PARAPHRASED * size))
        gone = set(np.linspace(0, n - 2, lost).astype(int).tolist())
        for before in range(16):
            text = [f"a{k}" for k in range(40 + before)] + [f"b{k}" if k in gone else w for k, w in enumerate(item)] + [item[-1]] + [f"c{k}" for k in range(60)]
            got = list(search.matches([" ".join(text).encode()]))
            assert [(g[0], g[1]) for g in got] == [(0, 1)], (n, before)


def test_copies_are_found_whatever_their_cosine():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghik") for _ in range(6)) for _ in range(3000)] + ["the", "of", "and"] * 300
    sizes = [1, 2, 3, 7, 8, 10, 15, 33, 47, 64]
    items = [[rng.choice(vocab[:3000]) for _ in range(n)] for n in sizes * 30]
    search = d.Search(d.passages_of([(k, " ".join(w)) for k, w in enumerate(items)]), np.ones(d.DIMENSIONS, np.float32), np.zeros((d.DIMENSIONS, 1)))
    for k, item in enumerate(items):
        part, n = list(item), len(item)
        if n >= d.SHORT and k >= len(sizes) * 10:  # a fifth of the words change
            for j in rng.sample(range(n), n - int(np.ceil(d.COPIED * n))):
                part[j] = "changed"
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 60))] + part + [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        assert k in {g[1] for g in search.matches([b"x y", " ".join(text).encode()]) if g[0] == 1}, (k, n)


def plain(text: str, item: str) -> bool:
    """Whether a text holds an item of at most 64 words, by the table over every window."""
    bare = lambda t: [w.strip(".!?,").lower() for w in t.split()]
    a, b = bare(item), bare(text)
    width = len(a) + len(a) // 2 + 1
    lines = [x for x in re.split(r"\n|(?<=[.!?])\s", item.strip()) if x.strip()]
    answer = set(bare(lines[-1])) if len(lines) > 1 else set()
    for k in range(max(1, len(b) - width + 1)):
        part = b[k : k + width]
        if sum((Counter(a) & Counter(part)).values()) < d.PARAPHRASED * len(a):
            continue
        share = lcs(a, part) / len(a)
        answered = not answer or len(answer & set(part)) >= d.ANSWERED * len(answer)
        if share == 1 or len(a) >= d.SHORT and (share >= d.COPIED or share >= d.PARAPHRASED and answered):
            return True
    return False


def paraphrases(seed: int, share: float):
    """Items of one and of two sentences, and texts with an item of which a share of the words changed."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(3, 9))) for _ in range(900)] + ["the", "of", "and"] * 100
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: say(rng.randint(18, 50)) for i in range(40)}
    told = {i: " ".join(w) if i % 2 else " ".join(w[:-6]) + ". " + " ".join(w[-6:]) for i, w in items.items()}
    texts = {}
    for k in range(160):
        words = say(rng.randint(0, 200))
        if k % 2:
            part = list(items[k % 40])
            free = len(part) if k % 40 % 2 else len(part) - 6  # an answer apart stays
            for j in rng.sample(range(free), int(share * free)):
                part[j] = rng.choice(vocab)
            cut = rng.randint(0, len(words))
            words = words[:cut] + part + words[cut:]
        texts[k] = " ".join(words)
    return told, texts


@pytest.mark.parametrize("share, least", [(0.1, 1.0), (0.2, 1.0), (0.3, 0.95), (0.4, 0.7)])
def test_paraphrases_match_a_search_of_everything(spark, monkeypatch, share, least):
    items, texts = paraphrases(int(share * 10), share)
    want = {(k, i) for k, t in texts.items() for i, x in items.items() if plain(t, x)}
    planted = {(k, k % 40) for k in texts if k % 2}
    assert len(want & planted) >= least * len(planted)
    docs = spark.createDataFrame([(k, t, None, None, None, "", 0, "") for k, t in texts.items()], SCHEMA)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find(docs, benchmark).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)
    monkeypatch.setattr(d, "PASSAGES", 7)
    assert {(r.doc_id, r.item_id) for r in d.find(docs, benchmark).collect()} == got


def test_a_benchmark_beyond_its_bound_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", None, None, None, "", 0, "")], SCHEMA)
    monkeypatch.setattr(d, "MOST_BYTES", 20)
    with pytest.raises(ValueError):
        d.find(docs, spark.createDataFrame([(1, "some words of an item")], "item_id long, text string"))


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None, "", 0, "")], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find(docs, none).count() == 0 and d.clean(docs, none).count() == 1
