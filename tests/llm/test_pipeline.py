from __future__ import annotations

import random

import __spark_entry__ as entry
import corpus_pipeline

from . import brute
from .fixtures import SCHEMA, frame, texts


def docs_table():
    rng = random.Random(11)
    docs = texts(50, 9)
    vocab = ["the", "of", "and", "to", "in"] * 40 + ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    items = {i: say(25) for i in range(5)}
    for i in range(300, 420):
        docs[i] = "\n".join(say(rng.randint(30, 60)) for _ in range(rng.randint(2, 6)))
    for i in range(420, 440):
        docs[i] = docs[300 + i - 420]
    for i in range(440, 450):
        docs[i] = say(60) + "\n" + items[i % 5] + "\n" + say(60)
    for i in range(450, 470):
        docs[i] = " ".join(w + "###" for w in say(90).split())
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = docs_table()
    start = frame(spark, docs)
    start.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    rows, now = {}, start
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        if name != "best_fit_packing":
            assert now.columns == start.columns
            rows[name] = {r.doc_id: r.text for r in now.collect()}
    kept = rows["quality_rules"]
    assert all(not brute.quality(t)[-1] for t in kept.values())
    assert set(range(300, 450)) <= set(kept) and not set(range(450, 470)) & set(kept)
    assert {d: t or "" for d, t in rows["line_dedup"].items()} == brute.line_dedup(kept)
    groups = brute.near_copies(rows["line_dedup"])
    assert set(rows["simhash_near_dedup"]) == set(groups.values())
    leaked = {d for d, t in rows["simhash_near_dedup"].items() if any(x in (t or "") for x in items.values())}
    assert leaked and set(rows["benchmark_decontamination"]) == set(rows["simhash_near_dedup"]) - leaked
    packed = now.collect()
    assert {r.doc_id for r in packed} == set(rows["benchmark_decontamination"])
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in entry.queries()["pipeline"](spark, str(tmp_path)).collect()) == want


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """Rows under one null or repeated id stay or go for their own text."""
    docs, items = docs_table()
    good, other, junk = docs[300], docs[301], docs[450]
    leak = docs[302] + "\n" + items[0]
    rows = [(None, good), (None, junk), (None, leak), (7, other), (7, junk), (7, leak + " tail")] + [(i, docs[i]) for i in range(303, 420)]
    df = spark.createDataFrame([(d, t, None, None, None, "", 0, "") for d, t in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = lambda out: sorted((r.doc_id or -1, r.text) for r in out.where("doc_id IS NULL OR doc_id < 10").collect())
    kept = corpus_pipeline.quality_rules(spark, df, str(tmp_path))
    assert left(kept) == sorted([(-1, good), (-1, leak), (7, other), (7, leak + " tail")])
    clean = corpus_pipeline.decontamination(spark, df, str(tmp_path))
    assert left(clean) == sorted([(-1, good), (-1, junk), (7, other), (7, junk)])


def test_an_empty_corpus_passes_through(spark, tmp_path):
    frame(spark, {}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    found = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert found == {f"op{n}" for n in range(1, 11)} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
