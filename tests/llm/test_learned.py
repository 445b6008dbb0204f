from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from faultline.llm import language, neighbours, queries

from .fixtures import SCHEMA

WORDS = {
    "en": "the of and water house green with from morning letter window people should through",
    "fr": "le la des une avec été être maison fenêtre garçon leçon peuple toujours où matin",
    "de": "der die das und nicht für über straße häuser größe mädchen immer morgen brief",
}


def corpus(n: int = 600, seed: int = 2):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        vocab = WORDS[lang].split()
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        if not good:
            words = [w + "###" for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang if i % 3 else None, "s", None, "", 0, ""))
        marks.append((i, int(good), 0))
    rows += [(n, None, "en", None, None, "", 0, ""), (n + 1, "", "fr", None, None, "", 0, ""), (n + 2, "123 ### 456", "de", None, None, "", 0, ""), (None, "the water and the house", "en", None, None, "", 0, "")]
    return rows, marks


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_languages_of_held_out_texts(spark):
    rows, _ = corpus()
    truth = {r[0]: next(k for k, v in WORDS.items() if {w.upper() for w in v.split()} & set(r[1].upper().replace("#", "").replace("!", "").split()) - {"DES", "DIE"}) for r in rows[:600]}
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert len(out) == len(rows)
    assert all(out[i].held_out == held(i) for i in range(600))
    assert np.mean([out[i].lang_pred == truth[i] for i in range(600) if held(i)]) > 0.97
    assert all((out[i].lang_pred, out[i].score) == ("und", 0.0) for i in (600, 601, 602))
    assert all(0 <= r.score <= 1 for r in out.values())


def test_rare_languages_keep_their_rows(spark, monkeypatch):
    langs = ["a"] * 400 + ["b"] * 400 + ["c"] * 400 + ["rare"] * 20
    rows = [(i, f"text {i}", lang, None, None, "", 0, "") for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows + rows[:3] * 50, SCHEMA)
    monkeypatch.setattr(language, "PER_LANGUAGE", 20)
    monkeypatch.setattr(language, "fit", lambda x, labels: labels)
    learned = language.learn(docs)
    assert learned.count("rare") == sum(not held(i) for i, lang in enumerate(langs) if lang == "rare")
    assert all(5 < learned.count(x) <= 20 for x in "abc")
    many = spark.createDataFrame([(i, f"text {i}", f"lang{i % 90}", None, None, "", 0, "") for i in range(900)], SCHEMA)
    assert len(set(language.learn(many))) == 90  # all of them
    monkeypatch.setattr(language, "SAMPLE", 3)
    with pytest.raises(ValueError):
        language.learn(docs)


def test_presence_kernel_counts_shared_grams():
    texts = [b"abcabc", b"abd", b""]
    x = language.presence(texts)
    grams = [{t[i : i + k] for k in language.ORDERS for i in range(len(t) - k + 1)} for t in texts]
    assert [int(v) for v in x.sum(1)] == [len(g) for g in grams]
    assert int(x[0].astype(int) @ x[1]) == len(grams[0] & grams[1])


def test_long_texts_in_segments(monkeypatch):
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(3000)).encode()
    whole = language.presence([text])
    monkeypatch.setattr(language, "SEGMENT", 501)
    assert (language.presence([text, b"short"])[0] == whole[0]).all()
    monkeypatch.setattr(neighbours, "PIECE", 4099)
    pieces = [text[k : k + 4099] for k in range(0, len(text), 4099)]
    assert (neighbours.counts([text]) == sum(neighbours.counts([p]) for p in pieces)).all()


def test_scores_match_dense_kernel_regression():
    """With every row a landmark, the scores are those of weighted kernel ridge regression over sets of n-grams."""
    rows, _ = corpus(60, 5)
    texts = [r[1].encode() for r in rows[:60]]
    labels = ["x" if i % 3 else "y" for i in range(40)]
    grams = [{t.lower()[i : i + k] for k in language.ORDERS for i in range(len(t) - k + 1)} for t in texts]
    kernel = np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in grams] for a in grams])
    y = np.array([[1.0 if v == lang else -1.0 for lang in "xy"] for v in labels])
    w = np.diag([1 / labels.count(v) for v in labels])
    alpha = np.linalg.solve(w @ kernel[:40, :40] + language.RIDGE * np.eye(40), w @ y)
    want = kernel[40:, :40] @ alpha
    model = language.fit([np.packbits(r).tobytes() for r in language.presence(texts[:40])], labels, landmarks=1000)
    x = language.presence(texts[40:])
    got = x.astype(np.float32) @ model.table / language._lengths(x)
    assert np.abs(got - want).max() < 0.05  # n-grams that share a cell
    assert (model.score(x)[0] == want.argmax(1)).mean() > 0.9


def test_quality_of_held_out_texts(spark, tmp_path):
    rows, marks = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks + [(5, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in queries.op7_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    assert np.mean([out[i].predicted == q for i, q, _ in marks if held(i)]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())


def test_held_out_labels_change_nothing(spark):
    rows, marks = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    score = lambda m: {r.doc_id: r.score for r in neighbours.classify(docs, neighbours.learn(docs, spark.createDataFrame(m, "doc_id long, quality int, toxic int"))).collect()}
    a, b = score(marks), score([(i, 1 - q if held(i) else q, t) for i, q, t in marks])
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_votes_match_plain_cosines():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["ab", "cd", "EF!!", "gh#", "ij"], 30)).encode() for _ in range(40)]
    tf = neighbours.counts(texts)
    space = neighbours.Space(np.ones(neighbours.DIMENSIONS))
    space.basis = neighbours.randomised_svd(space.weigh(tf), 8).astype(np.float32)
    model = neighbours.Model(space, space.latent(tf), rng.integers(0, 2, 40).astype(float))
    got = model.score(texts[:5])
    for i in range(5):
        cos = sorted(((float(space.latent(tf[i : i + 1])[0] @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: neighbours.NEIGHBOURS]
        w = [max(c, 1e-3) ** 4 for c, _ in cos]
        assert abs(got[i] - sum(a * y for a, (_, y) in zip(w, cos, strict=True)) / sum(w)) < 1e-3


def test_idf_and_latent_space_match_dense_ones(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["ab", "cd", "EF!!", "gh#", "ij", "kl", "mn"], 20)).encode() for _ in range(50)]
    docs = spark.createDataFrame([(i, t.decode(), None, None, None, "", 0, "") for i, t in enumerate(texts)], SCHEMA)
    n, df = neighbours.document_counts(docs, neighbours.present, neighbours.DIMENSIONS)
    tf = neighbours.counts(texts)
    assert n == 50 and (df == (tf > 0).sum(0)).all()
    x = neighbours.Space(np.log((1 + n) / (1 + df)) + 0.1).weigh(tf).astype(np.float64)
    exact = np.linalg.svd(x, full_matrices=False)[2][:5].T
    made = neighbours.randomised_svd(x.astype(np.float32), 5).astype(np.float64)
    assert np.linalg.svd(exact.T @ made)[1].min() > 0.95  # the same subspace
    assert np.linalg.norm(x @ made) > 0.995 * np.linalg.norm(x @ exact)


def test_equal_neighbours_vote_in_sample_order():
    cos = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.3] * 5], np.float32)
    assert neighbours.nearest(cos, 3).tolist() == [[0, 1, 2], [0, 1, 2]]
    assert neighbours.nearest(cos, 5).tolist() == [[0, 1, 2, 3, 4]] * 2


def test_long_labelled_texts_are_their_own_neighbours(spark):
    docs = spark.createDataFrame([(i, f"common {'good' if i % 2 else 'bad'} " * 400 + f"w{i}", None, None, None, "", 0, "") for i in range(40)], SCHEMA)
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = neighbours.learn(docs, marks)
    cos = model.space.latent(neighbours.counts([("common good " * 400 + "w1").encode()])) @ model.vectors.T
    assert cos.max() > 0.9999


def test_no_labels_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty, language.learn(empty)).count() == 0
    docs = spark.createDataFrame([(1, "some words", None, None, None, "", 0, "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert language.identify(docs, language.learn(docs)).collect()[0].lang_pred == "und"
    assert neighbours.classify(docs, neighbours.learn(docs, none)).collect()[0].score == 0.5
