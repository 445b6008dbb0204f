from __future__ import annotations

import random
import time

import numpy as np
import pytest
from faultline.llm import common, queries, suffixes, windows, word_windows

from . import brute
from .fixtures import frame, save, texts


def passages(seed: int) -> dict[int, str | None]:
    """Copies, passages in differing surroundings, and runs that overlap."""
    rng = random.Random(seed)
    docs = texts(40, seed)
    vocab = [f"w{i}" for i in range(50)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = [say(k) for k in (20, 34, 35, 36, 50, 90)]
    for i in range(200, 260):
        docs[i] = " ".join(say(rng.randint(0, 30)) + " " + rng.choice(shared) for _ in range(rng.randint(1, 3)))
    for i in range(260, 270):
        src = docs[rng.randint(200, 259)]
        docs[i] = src[rng.randint(0, 40) : len(src) - rng.randint(0, 40)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, tmp_path, seed):
    docs = passages(seed)
    rows = queries.op9_substring_dedup(spark, save(spark, tmp_path, docs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute.word_windows(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, tmp_path, seed):
    docs = passages(seed)
    rows = queries.op4_suffix_array_dedup(spark, save(spark, tmp_path, docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute.substrings(docs)


@pytest.mark.parametrize("operator, plain", [(suffixes, brute.substrings), (word_windows, brute.word_windows)])
def test_split_anchors_lose_nothing(spark, operator, plain):
    docs = passages(3)
    runs, _ = operator.repeated_runs(frame(spark, docs), per_block=2)
    got: dict[int, set[int]] = {}
    for r in runs.collect():
        got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert {d: len(got.get(d, ())) for d in docs} == {d: w[1] for d, w in plain(docs).items()}


def test_suffix_array_sorts():
    rng = np.random.default_rng(2)
    for alphabet in (2, 3, 30, 256):
        text = rng.integers(0, alphabet, 800).astype(np.uint8)
        raw = text.tobytes()
        order = suffixes.suffix_array(text, 100)
        assert sorted(order.tolist()) == list(range(800))
        cut = [raw[i : i + 100] for i in order.tolist() if i <= 700]
        assert cut == sorted(cut)
        for wanted in (rng.random(800) < 0.3, np.arange(800) % 40 < 7):
            some = [i for i in suffixes.suffix_array(text, 100, wanted).tolist() if wanted[i]]
            assert sorted(some) == np.flatnonzero(wanted).tolist()
            cut = [raw[i : i + 100] for i in some if i <= 700]
            assert cut == sorted(cut)


def test_one_long_text_in_segments(monkeypatch):
    rng = np.random.default_rng(4)
    units = windows.mix(rng.integers(0, 60, 5_000_000).astype(np.uint64))
    text, p0, p1, *_ = windows.anchors(units, np.array([0, len(units)]), 9, 35)
    assert p0[0] == 0 and p1[-1] == len(units) - 35 and (p0[1:] == p1[:-1] + 1).all()


def odd_rows() -> list[tuple]:
    """Rows under repeated and null ids: equal, differing, and with repeats of their own."""
    t, u, v = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, t), (5, t), (5, u), (5, v + " " + v), (5, v + " " + v), (6, "x " + u), (None, v), (None, v), (None, t[:50]), (7, v), (8, None), (8, ""), (9, t + " " + t)]
    return [(d, x, None, None, None, "", 0, "") for d, x in rows]


@pytest.mark.parametrize("per_block", [2, 2000])
def test_rows_under_one_id_are_documents_of_their_own(spark, monkeypatch, per_block):
    """Against brute force over rows; equal rows keep their text but for what is earlier than both."""
    from .fixtures import SCHEMA

    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    for module in (suffixes, word_windows):
        monkeypatch.setattr(module.repeated_runs, "__defaults__", (module.SIZE, per_block))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffixes.dedup(df).collect())
    assert got == sorted(brute.substring_rows([(d, x) for d, x, *_ in rows]))
    alone = spark.createDataFrame(rows[:2], SCHEMA)
    assert [r.n_removed for r in suffixes.dedup(alone).collect()] == [0, 0]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, brute.sha(r.kept)) for r in word_windows.dedup(df).collect())
    texts = dict(enumerate(x for _, x, *_ in rows))
    assert got == sorted((rows[k][0] or -1, *w) for k, w in brute.word_windows(texts).items())


def test_empty_tables(spark):
    from .fixtures import SCHEMA

    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.dedup(none).count() == word_windows.dedup(none).count() == 0


def test_block_sizes_do_not_change_places(spark, monkeypatch):
    """An anchor that fills blocks in its task meets the rest of it in other tasks."""
    monkeypatch.setattr(windows, "MERGE_ROWS", 500)
    docs = {i: " ".join(f"s{k}" for k in range(40)) + f" {i}" for i in range(300)}
    runs, _ = word_windows.repeated_runs(frame(spark, docs), per_block=7)
    got: dict[int, set[int]] = {}
    for r in runs.collect():
        got.setdefault(r.id, set()).update(range(r.start, r.end))
    assert {d: len(got.get(d, ())) for d in docs} == dict.fromkeys(docs, 40)


def test_a_stash_leaves_no_shuffle_files(spark):
    """They count as disk until they go; the driver's garbage collection may be long in coming."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set[str]:
        files = disk.getAllFiles()
        return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    setting = spark.conf.get(common.CLEANUP, None)
    made = common.stash(spark.range(10_000).repartition(4, "id"), "shuffled")
    end = time.time() + 10
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(common.CLEANUP, None) == setting
    assert made.count() == 10_000


def join_rows(plan) -> int:
    """Rows that the joins of an executed plan made."""
    below = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
    return own + sum(join_rows(below.apply(k)) for k in range(below.size()))


def test_only_strings_that_occur_again_are_joined(spark):
    """Of what split blocks leave most occurs once; rows of one id are not earlier than each other."""
    rng = random.Random(8)
    once = [(k, -k, k % 50, 0, k % 97) for k in range(2_000)]
    again = [(-1 - rng.randint(0, 9), 7, rng.randint(0, 3), rng.randint(0, 1), rng.randint(0, 40)) for _ in range(60)]
    rows = once + again + again[:5]  # equal rows of documents leave equal places
    found = spark.createDataFrame([(*r, -1) for r in rows] + [(0, 0, 1, 0, 5, 300)], windows.RUNS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        runs = suffixes.meet_again(found, 100)
        got = [tuple(r) for r in runs.collect()]
        made = join_rows(runs._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    least = {w: min(d for v, _, d, *_ in again if v == w) for w, *_ in again}
    first = {(w, d, f): min(s for v, _, e, g, s in again if (v, e, g) == (w, d, f)) for w, _, d, f, _ in again}
    want = {(w, d, f, s) for w, _, d, f, s in again if d > least[w] or s > first[w, d, f]}
    assert sorted(got) == sorted((d, f, s, s + 100) for _, d, f, s in want)
    assert 0 < made <= len(again) + 5
