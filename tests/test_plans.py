from __future__ import annotations

import json

import pytest
from faultline.functions.classify import categories
from faultline.operators import relations, rules
from faultline.plans import config, registry
from faultline.plans.analyze import analyze, issue_limitations
from faultline.sinks import reports
from faultline.streaming import changes as streaming
from pyspark.sql import functions as F


def test_config_merge():
    made = config.parse({
        "schemaVersion": 1, "policyPacks": ["strict-review", "security-sensitive"], "thresholds": {"moderate": 10, "high": 30, "critical": 50},
        "sensitiveAreas": [{"id": "payments", "patterns": ["pay/**"]}], "rules": {"large-change": {"enabled": False, "weight": 7, "options": {"maxFiles": 5}}},
    })
    assert made.thresholds == (10, 30, 50) and made.areas == {"payments": ["pay/**"]}
    assert made.rules["large-change"] == rules.Setting(False, 7, {"maxFiles": 5, "maxLines": 250})
    assert made.rules["high-fan-in"].options == {"minFanIn": 3}
    packed = config.parse({"schemaVersion": 1, "policyPacks": ["strict-review", "security-sensitive"]})
    assert packed.thresholds == (15, 40, 70) and len(packed.areas) == 4 and "**/rbac/**" in packed.areas["authorization"]
    assert config.load(None) == config.Config()


@pytest.mark.parametrize("bad", [
    [], {}, {"schemaVersion": 2}, {"schemaVersion": 1, "x": 1}, {"schemaVersion": 1, "language": "rust"}, {"schemaVersion": 1, "policyPacks": ["strict-review"] * 2},
    {"schemaVersion": 1, "thresholds": {"moderate": 5, "high": 5, "critical": 9}}, {"schemaVersion": 1, "analysis": {"maxTraversalDepth": 101}},
    {"schemaVersion": 1, "sensitiveAreas": [{"id": "a", "patterns": ["x"]}, {"id": "a", "patterns": ["y"]}]}, {"schemaVersion": 1, "rules": {"r": {"weight": float("nan")}}}, {"schemaVersion": 1, "ignorePatterns": [""]},
])
def test_config_errors(bad):
    with pytest.raises(ValueError):
        config.parse(bad)


def test_registry():
    mine = rules.Rule("my-rule", 5, lambda facts, options: None)
    made = registry.create([registry.Plugin("mine", (mine,))])
    assert mine in made.rules and [r.id for r in made.rules] == sorted(r.id for r in made.rules) and [a.id for a in made.adapters] == ["python", "typescript"]
    for bad in (registry.Plugin("Bad Id"), registry.Plugin("p", (rules.Rule("large-change", 1, mine.evaluate),)), registry.Plugin("p", (rules.Rule("r", 10_001, mine.evaluate),)), registry.Plugin("p", api_version=2)):
        with pytest.raises(ValueError):
            registry.create([bad])
    with pytest.raises(ValueError):
        registry.create([registry.Plugin(f"p{i}") for i in range(33)])


@pytest.fixture(scope="module")
def result(spark):
    rows = [(1, "src/auth.ts", "modified", 3, 1), (1, "src/auth.test.ts", "added", 5, 0), (1, "src/index.ts", "modified", 1, 1), (1, "skip/x.ts", "added", 900, 0), (2, "README.md", "modified", 1, 0)]
    files = spark.createDataFrame(rows, "change_id int, path string, status string, additions long, deletions long")
    changes = spark.createDataFrame([(1, "b1", "h1"), (2, "b2", "h2"), (3, "b3", "h3")], "change_id int, base string, head string")
    exported = spark.createDataFrame([(1, "src/index.ts", "publicApi", "modified")], "change_id int, path string, name string, change string")
    facts = rules.Facts(files, tests=relations.test_relationships(files.select("path")), exports=exported)
    return analyze(changes, facts, config.parse({"schemaVersion": 1, "ignorePatterns": ["skip/**"]})).orderBy("change_id")


def test_analysis(result):
    one, two, three = result.collect()
    assert (one.score, one.classification, [f.id for f in one.findings]) == (35, "moderate", ["missing-related-tests:1:finding", "public-export:1:finding", "tests-added:1:finding"])
    assert [f.path for f in one.files] == ["src/auth.test.ts", "src/auth.ts", "src/index.ts"]
    assert (two.score, two.findings, three.files, three.classification) == (0, [], [], "low")
    assert one.limitations == sorted(one.limitations) and len(one.limitations) == 2


def test_reports(spark, result):
    text = {r.change_id: r.report for r in reports.render(result).collect()}["1"]
    assert text.startswith("Change risk: MODERATE (35)\nRevisions: b1..h1\nChanged files: 3 (+9 -2; 0 binary)\nFindings:\n- [MEDIUM] No related test changed: src/index.ts (+20): ")
    assert "- tests-added: -10 (1 finding)" in text
    md = {r.change_id: r.report for r in reports.render(result, reports.markdown).collect()}
    assert "**MODERATE** — score 35" in md["1"] and "No risk-rule findings." in md["3"]
    assert json.loads({r.change_id: r.report for r in reports.render(result, reports.as_json).collect()}["1"])["score"] == 35
    assert "default-src 'none'" in {r.change_id: r.report for r in reports.render(result, reports.page).collect()}["1"]
    assert reports.escape("a|b\r\n_c_<") == "a&#124;b &#95;c&#95;&lt;"
    issues = spark.createDataFrame([("1", "record-limit", 4), ("2", "file-size-limit", None)], "key string, issue string, line int")
    assert [r.limitation for r in issue_limitations(issues, "Coverage evidence").orderBy("change_id").collect()] == ["Coverage evidence unavailable: record-limit (line 4).", "Coverage evidence unavailable: file-size-limit."]


def test_markdown_stays_bounded():
    base = {"base": "b", "head": "h", "score": 1.5, "classification": "low", "files": [], "contributions": [], "limitations": []}
    finding = {"severity": "high", "rule_id": "r", "title": "t" * 2_000, "explanation": "e", "affected_paths": ["p"] * 9, "evidence_ids": ["x"], "weight": 2.0}
    out = reports.markdown(base | {"findings": [finding] * 60})
    assert len(out) <= reports.REPORT_END and "Remaining findings" in out
    assert "exceeded the safe size" in reports.markdown(base | {"findings": [finding], "limitations": ["x" * 70_000]})


def test_page_tells_evidence_and_guidance():
    finding = {"id": "r:1:finding", "severity": "high", "rule_id": "r", "title": "<t>", "explanation": "e", "remediation": "do & see", "affected_paths": ["p"], "evidence_ids": ["r:1:evidence", "gone"], "weight": 2.0}
    evidence = {"id": "r:1:evidence", "kind": "file-category", "summary": "1 file", "data": '{"fileCount": 1}', "source_paths": ["p"]}
    file = {"path": "p", "previous_path": "o", "status": "renamed", "additions": 1, "deletions": 2, "categories": ["source", "test"]}
    result = {"base": "b", "head": "h", "score": 2.0, "classification": "low", "files": [file], "findings": [finding], "evidence": [evidence], "contributions": [], "limitations": []}
    out = reports.page(result, {"nodes": [{"path": "p", "distance": 0}], "edges": [], "truncated": True, "unindexed": ["u.ts"]})
    for part in ("&lt;t&gt;", "do &amp; see", "#evidence-1", "gone", "1 file", "&quot;fileCount&quot;: 1", "source, test", "from o", "u.ts", "incomplete"):
        assert part in out, part
    assert json.loads(reports.as_json(result))["evidence"][0]["data"] == {"fileCount": 1}


def test_results_carry_their_evidence(spark):
    files = spark.createDataFrame([(1, "package.json", "modified", 1, 1), (1, "src/a.ts", "added", 900, 0)], "change_id int, path string, status string, additions long, deletions long")
    changes = spark.createDataFrame([(1, "b", "h"), (2, "b", "h")], "change_id int, base string, head string")
    out = {r.change_id: r for r in analyze(changes, rules.Facts(files)).collect()}
    one = out[1]
    assert [e.id for e in one.evidence] == [i for f in one.findings for i in f.evidence_ids] == ["dependency-manifest:1:evidence", "large-change:1:evidence"]
    assert all(f.explanation.endswith(".") and f.remediation.endswith(".") for f in one.findings)
    assert json.loads(one.evidence[1].data) == {"fileCount": 2, "lineCount": 902, "maxFiles": 20, "maxLines": 500}
    assert out[2].evidence == [] and out[2].findings == []


def test_stream_of_changes(spark, tmp_path):
    schema = "change_id int, path string, status string, additions long, deletions long"
    for k in range(2):
        spark.createDataFrame([(k, "package.json", "modified", 1, 1), (k, "db/migrations/1.sql", "added", 3, 0)], schema).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = streaming.start(stream, lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={i}")), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = {r.change_id: (r.score, r.classification) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (40.0, "moderate"), 1: (40.0, "moderate")}


def test_order_and_partitions_change_nothing(spark):
    rows = [(i % 5, f"{'src' if i % 2 else 'docs'}/f{i}.ts", "added", i * 40, i) for i in range(60)]
    files = spark.createDataFrame(rows, "change_id int, path string, status string, additions long, deletions long").withColumn("categories", categories("path"))
    run = lambda df: sorted(map(tuple, rules.evaluate(rules.Facts(df)).select("change_id", "finding_id", "severity", F.array_join("paths", ",")).collect()))
    assert run(files) == run(files.orderBy(F.desc("path")).repartition(7)) == run(files.coalesce(1))
