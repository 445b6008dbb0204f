from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from faultline.llm import packing, queries, simhash

from . import brute
from .fixtures import frame, save, texts


def test_components_match_brute_force(spark, tmp_path):
    docs = texts()
    rows = queries.op10_simhash_near_dedup(spark, save(spark, tmp_path, docs)).collect()
    fps = {d: brute.fingerprint(t) for d, t in docs.items()}
    want = brute.groups(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", want[d]) for d in docs}


def test_links_survive_splits_of_large_groups(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(6):
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0xABCD << 48 | rng.getrandbits(12) for _ in range(60)}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = simhash.components(simhash.links(nodes, max_group=5))
    got = {r.node & (1 << 64) - 1: r.label for r in found.collect()}
    want = brute.groups({simhash._signed(f): f for f in fps})
    size = defaultdict(int)
    for c in want.values():
        size[c] += 1
    assert got == {f & (1 << 64) - 1: c for f, c in want.items() if size[c] > 1}


def copies(seed: int) -> dict[int, str | None]:
    """Texts and edited copies of theirs, from a word in hundred to a third changed; clusters too."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)]
    docs = texts(30, seed)
    license = " ".join(rng.choice(vocab) for _ in range(60))
    for i in range(200, 320):
        docs[i] = " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 30, 120, 400]))) + (" " + license if i % 3 == 0 else "")
    for i in range(320, 520):
        words = docs[rng.randrange(200, i)].split()
        for _ in range(int(len(words) * rng.choice([0, 0.005, 0.01, 0.02, 0.05, 0.3]))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs[i] = " ".join(words) if i % 4 else " ".join(words).upper()
    return docs


@pytest.mark.parametrize("per_block", [2000, 6])
def test_near_copies_match_brute_force(spark, per_block):
    docs = copies(3)
    want = brute.near_copies(docs)
    assert 150 < len(set(want.values())) < 300
    found = simhash.near_copies(frame(spark, docs), per_block=per_block).collect()
    got = {r.id: r.first.id for r in found}
    assert set(got) == set(docs)
    if per_block == 2000:
        assert got == want
    else:  # blocks of a key meet by one set of each tree only; nothing is linked that should not be
        assert all(want[r] == want[i] for i, r in got.items())
        assert sum(got[i] != want[i] for i in docs) <= 0.02 * len(docs)


def test_keep_first_keeps_one_row_of_each_group(spark):
    from .fixtures import SCHEMA

    docs = copies(5)
    want = brute.near_copies(docs)
    out = simhash.keep_first(frame(spark, docs))
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    t, u = ("alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven")
    rows = [(None, t), (5, t), (5, t), (5, u), (5, u), (5, u), (6, u), (7, None), (8, ""), (None, "other words that stand alone here")]
    out = simhash.keep_first(spark.createDataFrame([(d, x, None, None, None, "", 0, "") for d, x in rows], SCHEMA))
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == [(-1, "alpha beta gamma delta epsilon zeta eta theta " * 3), (-1, "other words that stand alone here"), (5, u), (7, "")]


def test_close_pairs_match_every_pair():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.concatenate([fps, fps[:20] ^ np.uint64(5), fps[:10]])
    groups = np.sort(rng.integers(0, 3, len(fps)))
    order = np.lexsort((fps, groups))
    fps, groups = fps[order], groups[order]
    for budget in (0, 3, 24, 30):
        got = [(min(a, b), max(a, b)) for i, j in simhash.close_pairs(fps, groups, budget, 50) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if groups[a] == groups[b] and int(fps[a] ^ fps[b]).bit_count() <= budget}
        assert len(got) == len(set(got)) and set(got) == want


def test_packing_is_whole_and_close_to_the_bound(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    docs = texts() | {900: "word " * 9000, 901: "日本語 ½ ǅ text <|endoftext|> end", 902: "x" * 5000}
    rows = queries.op2_best_fit_packing(spark, save(spark, tmp_path, docs)).collect()
    tk = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, t in docs.items():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by_doc[d], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        at = 0
        for p in parts:
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
        assert all(p.length == 2048 for p in parts[1:]) and parts[0].length <= 2048
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    lengths = np.bincount([r.length for r in rows], minlength=2049)
    assert len(by_seq) <= packing.lower_bound(lengths, 2048) + 1


def test_gaps_are_exchanged_between_partitions(spark):
    rng = random.Random(5)
    docs = {i: "a b " * rng.choice([100, 260, 330, 420, 510]) for i in range(300)}
    few = packing.pack(frame(spark, docs), per_partition=20)
    rows = few.collect()
    bins = len({r.sequence_id for r in rows})
    whole = packing.best_fit_decreasing(np.sort([r.length for r in rows])[::-1], 2048)[2]
    assert bins <= len(whole) * 1.05 + 1
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = np.sort(rng.integers(1, 101, rng.integers(1, 60)))[::-1]
        bins, offsets, left = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(left)
        assert (np.bincount(bins, lengths) <= 100).all()


def test_rows_of_one_id_never_share_a_place(spark):
    """Ten times as many rows of one doc_id as a partition packs, and some under a null one."""
    from .fixtures import SCHEMA

    rng = random.Random(8)
    rows = [(7, "a b " * 300, None, None, None, "", 0, "")] * 200 + [(None, "c d " * rng.randint(1, 900), None, None, None, "", 0, "") for _ in range(40)] + [(1 << 60, "e", None, None, None, "", 0, "")]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(2), per_partition=20).collect()
    by_seq = defaultdict(list)
    for r in out:
        by_seq[r.sequence_id].append(r)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert sum(r.piece == 0 for r in out) == len(rows) and any(r.doc_id == 1 << 60 for r in out)
    groups = {(r.round, r.part): (r.bins, r.bound) for r in out}
    assert all(bins >= bound > 0 for bins, bound in groups.values())


@pytest.mark.parametrize("seed, per_block", [(3, 6), (4, 2), (5, 1)])
def test_blocks_of_a_frequent_key_lose_no_link(spark, seed, per_block):
    docs = copies(seed)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    for i in range(600, 700):  # a chain: neighbours are near copies, most others share keys only
        words[rng.randrange(200)] = f"x{i}"
        docs[i] = " ".join(words)
    want = brute.near_copies(docs)
    assert {r.id: r.first.id for r in simhash.near_copies(frame(spark, docs), per_block=per_block).collect()} == want


def test_pairs_between_two_sides():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 80, np.uint64)
    groups, sides = rng.integers(0, 4, 80), rng.integers(0, 2, 80)
    sides[groups == 2] = 1
    order = np.lexsort((fps, sides, groups))
    fps, groups, sides = fps[order], groups[order], sides[order]
    for budget, leaf in ((24, 1), (30, 16), (64, 64)):
        got = [(min(a, b), max(a, b)) for i, j in simhash.close_pairs(fps, groups, budget, 50, sides, leaf) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        meet = lambda a, b: groups[a] == groups[b] and (sides[a] != sides[b] or groups[a] == 2)
        want = {(a, b) for a in range(80) for b in range(a + 1, 80) if meet(a, b) and int(fps[a] ^ fps[b]).bit_count() <= budget}
        assert len(got) == len(set(got)) and set(got) == want
