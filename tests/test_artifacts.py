"""Queries over written artifacts, on tables beyond what one artifact may hold."""

from __future__ import annotations

import duckdb
import pytest
from faultline.plans.artifact_queries import ORACLES
from faultline.plans.queries import QUERIES
from faultline.sources import coverage, texts
from pyspark.errors import PythonException


def parts(spark, folder, rows: str) -> str:
    """A folder with a part table of p_partkey, p_brand and p_size."""
    spark.sql(rows).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return con


def test_coverage_files_beyond_the_limits_keep_every_record(spark, tmp_path):
    # 1,200,000 lines in one folder, one path twice
    at = parts(spark, tmp_path, "SELECT 48 * (id % 39) AS p_partkey, 'b' AS p_brand, 30000 AS p_size FROM range(40)")
    each = "path, count(*) AS n, count(line) AS n_lines, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(hits) AS BIGINT) AS hits, max(lines_found) AS found, max(lines_hit) AS hit"
    QUERIES["lcov_records"](spark, at).createOrReplaceTempView("coverage_found")
    got = spark.sql(f"SELECT {each} FROM coverage_found GROUP BY path").collect()
    want = duck(at).execute(f"SELECT {each} FROM ({ORACLES['lcov_records']}) GROUP BY path").fetchall()
    assert len(want) > 30 and sum(r[1] for r in want) > 1_000_000
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_owner_files_beyond_the_limits_keep_every_rule(spark, tmp_path):
    # 10,050 rules of one brand, 50 of none, and paths that stand more than once
    at = parts(spark, tmp_path, "SELECT id % 10000 AS p_partkey, CASE WHEN id < 10050 THEN 'b' END AS p_brand, 1 AS p_size FROM range(10100)")
    columns = "brand, ordinal, pattern, owners"
    got = QUERIES["owner_rules"](spark, at).select(*columns.split(", ")).collect()
    want = duck(at).execute(f"SELECT {columns} FROM ({ORACLES['owner_rules']})").fetchall()
    assert len(want) == 10_100 and sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_strict_parsing_fails_for_what_cannot_be_read(spark):
    good = "SF:a\nLF:0\nLH:0\nend_of_record\n"
    schema = "path string, lines_found long, lines_hit long, line long, hits long"
    table = spark.createDataFrame([("good", good), ("bad", good + "XX:1\n")], "artifact string, text string")
    assert texts.parse(table.where("artifact = 'good'"), "artifact", coverage.lcov, schema, strict=True)[0].count() == 1
    with pytest.raises(PythonException, match="artifact 'bad' cannot be read: unsupported-record:5"):
        texts.parse(table, "artifact", coverage.lcov, schema, strict=True)


@pytest.mark.parametrize(("size", "issue"), [("1000000", "file-size-limit"), ("CAST(NULL AS INT)", "invalid-record")])
def test_coverage_files_that_cannot_be_read_fail_the_query(spark, tmp_path, size, issue):
    at = parts(spark, tmp_path, f"SELECT id AS p_partkey, 'b' AS p_brand, CASE WHEN id = 1 THEN {size} ELSE 1 END AS p_size FROM range(8)")
    with pytest.raises(PythonException, match=issue):
        QUERIES["lcov_records"](spark, at).count()


def test_owner_files_that_cannot_be_read_fail_the_query(spark, tmp_path):
    at = parts(spark, tmp_path, "SELECT CASE WHEN id > 0 THEN id END AS p_partkey, 'b' AS p_brand, 1 AS p_size FROM range(8)")
    with pytest.raises(PythonException, match="unsupported-pattern"):
        QUERIES["owner_rules"](spark, at).count()
