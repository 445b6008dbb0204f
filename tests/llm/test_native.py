from __future__ import annotations

import random

from faultline.llm import common, lines, queries, quality, secrets
from pyspark.sql import functions as F

from . import brute
from .fixtures import SCHEMA, frame, save, texts


def test_secret_spans_match_brute_force(spark, tmp_path):
    docs = texts()
    rows = queries.op1_secret_scans(spark, save(spark, tmp_path, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.secrets(docs[r.doc_id]), docs[r.doc_id]


def test_owner_specific_values_are_told_from_copied_ones(spark):
    key, common = "Zk9" + "aB3x" * 8, "Qw7" + "cD4y" * 8
    rows = [(i, f"see {common} here", None, f"o{i}", None, "", 0, "") for i in range(6)] + [(9, f"mine {key}", None, "o1", None, "", 0, ""), (10, None, None, None, None, "", 0, "")]
    out = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(s.start, s.kind, s.end, s.owners, s.copied) for s in out[9]] == [(5, 3, 5 + len(key), 1, False)]
    assert out[0] == [] and out[10] == []


def test_copied_and_owned_spans_come_through_the_query(spark, tmp_path):
    """Owned spans against plain sets of owners, also where base spans overlap them."""
    rng = random.Random(4)
    keys = ["".join(rng.choice("abcXYZ0189") for _ in range(30)) + "aZ9" for _ in range(12)] + ["0123456789abcdef0123" + "Zz9" * 5]
    rows = []
    for i in range(80):
        said = [rng.choice(["see", "key:", "token=", "é𝒳", "deadbeefdeadbeef01", "x"]) + rng.choice([" ", ""]) + rng.choice(keys[: 1 + i % 13]) for _ in range(rng.randint(0, 5))]
        rows.append((i, " ".join(said) or None, None, rng.choice([None, "s1", "s2", "s3"]) if i % 13 < 6 else f"s{i % 2}", None, "", 0, ""))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in queries.op1_secret_scans(spark, str(tmp_path)).collect()}
    want = brute.owned(rows)
    assert {i: r.spans for i, r in out.items()} == want
    assert any(r.n_copied for r in out.values()) and any("owned" in x for x in want.values())


def test_repositories_count_too(spark):
    key = "Zk9" + "aB3x" * 8
    rows = [(i, f"see {key} here", f"repo{i}", "one owner", None, "", 0, "") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert all(r.spans == [] for r in secrets.scan(df, repository="lang").collect())
    assert all([s.repositories for s in r.spans] == [4] for r in secrets.scan(df.where("doc_id < 4"), repository="lang").collect())


def test_many_matches_in_one_text(spark):
    """Twice the matches take about twice the time, and all are found."""
    import time

    took = []
    for n in (20_000, 200_000):
        df = spark.createDataFrame([(1, "deadbeefdeadbeef01 x " * n, None, None, None, "", 0, "")], SCHEMA)
        began = time.time()
        spans = secrets.scan(df).collect()[0].spans
        took.append(time.time() - began)
        assert len(spans) == n and spans[-1].start == 21 * (n - 1) and spans[-1].end == 21 * n - 3
    assert took[1] < 10 * took[0] + 30


def test_quality_statistics_match_brute_force(spark, tmp_path):
    docs = texts()
    for r in queries.op3_quality_rules(spark, save(spark, tmp_path, docs)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_em_matches_a_plain_loop(spark):
    import math

    votes = [[1, 1, 0]] * 60 + [[-1, 0, 1]] * 9 + [[-1, -1, -1]] * 20 + [[1, 0, 0]] * 11
    got = quality.fit(spark.createDataFrame([(v,) for v in votes], "votes array<int>"), 3, 12)
    n = len(votes)
    place = {-1: 0, 1: 1, 0: 2}
    share = [0.8] + [0.2 / 3] * 3
    pi = list(share)
    t = [[[0.02, 0.98, 1.0]] * 3] + [[[0.9, 0.02, 0.08] if r == k else [0.3, 0.7, 1.0] for r in range(3)] for k in range(3)]
    for _ in range(12):
        g = []
        for v in votes:
            w = [pi[c] * math.prod(t[c][r][place[v[r]]] for r in range(3)) for c in range(4)]
            g.append([x / sum(w) for x in w])
        pi = [(0.01 * n * share[c] + sum(x[c] for x in g)) / (1.01 * n) for c in range(4)]
        for c in range(4):
            for r in range(3):
                bad, good, none = (sum(x[c] for x, v in zip(g, votes, strict=True) if v[r] == vote) for vote in (-1, 1, 0))
                if c == r + 1:
                    made = [(0.03 * n * m + x) / (0.03 * n + bad + good + none) for m, x in zip((0.9, 0.02, 0.08), (bad, good, none), strict=True)]
                else:
                    weight, prior = (0.1, 0.02) if c == 0 else (0.001, 0.3)
                    chance = (weight * n * prior + bad) / (weight * n + bad + good)
                    made = [chance, 1 - chance, 1.0]
                t[c] = [made if k == r else x for k, x in enumerate(t[c])]
    for c in range(4):
        assert abs(got[c]["pi"] - pi[c]) < 1e-9
        assert all(abs(x - y) < 1e-9 for a, b in zip(got[c]["t"], t[c], strict=True) for x, y in zip(a, b, strict=True))


def test_rules_that_conflict_are_weighed(spark):
    """A bad vote goes by what the rule's bad votes usually come with, not by all-must-pass."""
    clean, junk = [1] * 8, [1, -1, 1, 1, 1, 1, -1, 1]
    alone, foreign = [1, -1, 1, 1, 1, 1, 1, 1], [1, 1, 1, 1, 1, 1, -1, 1]
    votes = [clean] * 850 + [junk] * 70 + [alone] * 2 + [foreign] * 3
    rules = [(str(k), F.col("votes")[k] == 1, F.col("votes")[k] == -1) for k in range(8)]
    df = spark.createDataFrame([(v,) for v in votes], "votes array<int>")
    scored = df.distinct().withColumn("p", quality.posterior(quality.fit(df, 8), rules))
    kept = {tuple(r.votes): r.p >= 0.5 for r in scored.collect()}
    assert kept == {tuple(clean): True, tuple(junk): False, tuple(alone): True, tuple(foreign): True}


def test_junk_is_rejected_and_prose_is_kept(spark):
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice(["the", "of", "and", "river", "stone", "green", "walk", "to", "in", "house", "light", "over", "seven", "paper"]) + ("." if i % 9 == 8 else "") for i in range(90)) + "."
    prose = [(i, " ".join(w + str(rng.randint(0, 99)) if k % 3 == 0 else w for k, w in enumerate(say().split())) + ".", None, None, None, "", 0, "") for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###" for w in say().split()), None, None, None, "", 0, "") for i in range(12)] + [(2000 + i, say().upper().replace(" ", "!! "), None, None, None, "", 0, "") for i in range(12)]
    out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(prose + junk, SCHEMA)).collect()}
    assert all(out[r[0]] for r in prose) and not any(out[r[0]] for r in junk)


def test_lines_match_brute_force(spark):
    docs = texts()
    want = brute.line_dedup(docs)
    rows = lines.dedup(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.text or "") == want[r.doc_id]
        assert r.lines == "x" and r.words == "y"


def test_empty_tables(spark, tmp_path):
    none = save(spark, tmp_path, {})
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for q in queries.queries().values():
        assert q(spark, none).count() == 0


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    rows = spark.createDataFrame([(i, i % 3 if i < 60 else i) for i in range(90)], "row int, k int")
    small = rows.where("k <> 61").groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(small, "k").select("row", "k", "n").collect()))
    assert sorted(map(tuple, common.join_hot(rows, small, ["k"], "n").select("row", "k", "n").collect())) == want
