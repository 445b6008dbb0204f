from __future__ import annotations

import pytest
from faultline.functions import classify, paths, patterns, stats
from faultline.operators import ownership
from pyspark.sql import functions as F


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").select("x").collect()]


TYPESCRIPT = {
    "src/index.ts": "source", "src/index.test.ts": "source,test", "docs/guide.md": "documentation", "package-lock.json": "dependency,lockfile",
    "dist/client.generated.js": "source,generated", "terraform/main.tf": "infrastructure", ".github/workflows/ci.yml": "ci", "prisma/migrations/001/schema.sql": "migration",
    "vitest.config.ts": "source,configuration", "public/logo.svg": "asset", "NOTICE": "other", "a\\Docs\\x.TS": "source,documentation", "bun.lock": "dependency,lockfile", "deno.jsonc": "dependency",
    "src/index.ts\n": "other",
}
PYTHON = {"src/service.py": "source", "src/service.pyi": "source", "test_service.py": "source,test", "service_test.py": "source,test", "tests/service.py": "source,test", "tests/service.pyi": "source", "src/service.ts": "other"}


@pytest.mark.parametrize("language,golden", [("typescript", TYPESCRIPT), ("python", PYTHON)])
def test_classifier(spark, language, golden):
    assert [",".join(x) for x in column(spark, golden, lambda c: classify.categories(c, language))] == list(golden.values())
    with pytest.raises(ValueError):
        classify.tests("rust")


RULES = [("*", ["@global"]), ("*.ts", ["@typescript"]), ("/docs/", ["@docs"]), ("docs/*", ["@docs-direct"]), ("src/**/generated/*", ["@generated"]), ("src/auth/*.ts", ["@auth", "@org/security"]), ("src/auth/login.ts", ["owner@example.com"]), ("apps/", ["@apps"]), ("/apps/github", []), ("**/logs", ["@logs"]), ("/root-only/", ["@root"])]
OWNED = {
    "README.md": ["@global"], "apps/github/action.ts": [], "apps/web/index.ts": ["@apps"], "nested/apps/tool.ts": ["@apps"], "build/logs/archive.txt": ["@logs"],
    "docs/direct.md": ["@docs-direct"], "docs/guide/setup.md": ["@docs"], "nested/root-only/file.ts": ["@typescript"], "root-only/file.ts": ["@root"],
    "src/auth/login.ts": ["owner@example.com"], "src/auth/token.ts": ["@auth", "@org/security"], "src/deep/generated/client.ts": ["@generated"],
}


@pytest.mark.parametrize("unrolled", [200, 0])
def test_owners(spark, unrolled):
    files = spark.createDataFrame([(p,) for p in OWNED], "path string")
    assert {r.path: r.owners for r in ownership.match(files, RULES, unrolled).collect()} == OWNED


def test_owner_globs(spark):
    files = spark.createDataFrame([("src/index.ts",), ("deep/path/value.md",), ("src/file1.ts",)], "path string")
    assert {r.path: r.owners for r in ownership.match(files, [("docs/**", ["@d"])]).collect()}["src/index.ts"] == []
    got = {r.path: r.owners for r in ownership.match(files, [("**", ["@all"]), ("file?.ts", ["@numbered"])]).collect()}
    assert got["deep/path/value.md"] == ["@all"] and got["src/file1.ts"] == ["@numbered"]
    assert all(patterns.owner_regex(p) is None for p in ("!x", "a[b]", "a//b", "./a", "a/../b", "/", "a\\b"))
    with pytest.raises(ValueError):
        ownership.match(files, [("!x", [])])


def test_globs(spark):
    cases = [("**/auth/**", "src/auth/x/y.ts", True), ("*.ts", "a/b.ts", False), ("src/?.ts", "src/a.ts", True), ("a+b", "a+b", True), ("**", "x\ny", True)]
    for pattern, path, want in cases:
        assert column(spark, [path], lambda c, p=pattern: c.rlike(patterns.glob_regex(p))) == [want]
    with pytest.raises(ValueError):
        patterns.glob_regex("")


def test_test_keys(spark):
    ts = {"packages/api/src/auth.ts": "packages/api/auth", "packages/api/test/auth.spec.ts": "packages/api/auth", "src/billing.d.ts": "billing"}
    assert column(spark, ts, paths.test_key) == list(ts.values())
    py = {"src/package/helper.py": "package/helper", "tests/package/helper_test.py": "package/helper", "tests/package/test_worker.py": "package/worker"}
    assert column(spark, py, lambda c: paths.test_key(c, "python")) == list(py.values())


def test_paths(spark):
    good = ["a/b.ts", "x"]
    bad = ["", "/a", "a//b", "../a", "a/./b", "a\\b", "a\0b", "a/", "x" * 1001]
    assert column(spark, good + bad, paths.valid_path) == [True] * 2 + [False] * 9
    assert column(spark, ["a/index.ts", "index.d.mts", "reindex.ts", "a/INDEX.jsx"], paths.is_entry_point) == [True, True, False, True]
    assert column(spark, ["a/b", "b"], paths.area) == ["a", "(root)"]


def test_statistics(spark):
    assert column(spark, [-2.5, 2.5, 1.005], lambda c: stats.half_up(c, 0), "double") == [-2.0, 3.0, 1.0]
    low = column(spark, [0, 5, 10], lambda c: stats.wilson(c, F.lit(10)), "bigint")
    assert low[0].lower == 0 and abs(low[1].lower - 0.236593) < 1e-6 and low[2].upper > 1 - 1e-9
    assert column(spark, [1], lambda c: stats.wilson(c * 0, c * 0), "bigint")[0] == (0, 0, 0)
    texts = {"Ownership…": "ownership", "unrecognised": "other", " Language analysis x": "language-index", "Revision source reads": "public-surface", "Baseline coverage": "baseline-coverage", "Coverage": "coverage"}
    assert column(spark, texts, stats.limitation_category) == list(texts.values())
    assert column(spark, [0.0, 20.0, 50.0, 80.0], stats.classify_score, "double") == list(stats.CLASSES)
    assert column(spark, ["low", "high", "critical"], lambda c: stats.gate(c, "high")) == [0, 2, 2]
    assert column(spark, ["critical"], lambda c: stats.gate(c, "none")) == [0]
    with pytest.raises(ValueError):
        stats.classify_score(F.lit(1), (20, 20, 80))
