"""Nulls, repeated rows, long texts and clashing columns through every operator."""

from __future__ import annotations

import corpus_pipeline
import pytest
from faultline.llm import queries
from pyspark.sql import functions as F

NAMES = "gone gone_ id row fold starts ends lines words spans part fp mask label node h e p0 p1 q n text_ votes posterior kept order key runs marks hash owner"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    prose = "the river and the house of stone stood over a field of grass where seven birds sang in the light of a morning that was not yet warm "
    rows = [(None, None, None, None), (None, prose * 2, "en", None), (1, prose * 3, "en", "a"), (1, prose * 3, "en", "a"), (2, "", None, "b"), (3, " \t\n\r\x0b\x0c ", None, "b"), (4, "é", "fr", "c"), (5, prose * 2000, "en", "a")]
    rows += [(5, "another text under the same id " * 20, "en", "b"), (6, "\x00\x01 nul bytes   and separators \u0085", None, None), (7, "𝒳 " * 80, "en", "a"), (8, "x" * 300_000, None, "a"), (9, "token = \"" + "A1b" * 50 + "\"", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df = df.select("*", *[F.lit("clash").alias(c) for c in NAMES.split()])
    df.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(None, "one two three"), (1, None), (2, prose.strip())], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, None), (7, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), len(rows)


ROW_WISE = [q for q in queries.queries() if not q.startswith(("op2_", "op8_"))]


@pytest.mark.parametrize("name", ROW_WISE)
def test_one_row_for_every_row(spark, odd, name):
    at, n = odd
    assert len(queries.queries()[name](spark, at).collect()) == n


def test_packing_holds_every_row(spark, odd):
    at, n = odd
    rows = queries.op2_best_fit_packing(spark, at).collect()
    assert sum(r.piece == 0 for r in rows) == n


def test_leaks_under_null_and_repeated_ids(spark, odd):
    got = {(r.doc_id, r.item_id) for r in queries.op8_benchmark_decontamination(spark, odd[0]).collect()}
    assert got == {(None, 2), (1, 2), (5, 2)}


def test_stages_keep_the_columns(spark, odd):
    at, _ = odd
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        out.collect()
