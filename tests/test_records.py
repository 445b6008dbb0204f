from __future__ import annotations

import json
import stat

from faultline.operators import checks, evaluation, graph
from faultline.sinks import outputs
from faultline.sources import records


def test_events(spark, tmp_path):
    side = lambda sha, name: {"sha": sha, "repo": {"full_name": name}}
    given = {
        "pull": {"number": 7, "pull_request": {"base": side("b", "o/r"), "head": side("h", "o/r")}},
        "fork": {"number": 8, "pull_request": {"base": side("b", "o/r"), "head": side("h", "x/r")}},
        "push": {"before": "1", "after": "2"},
        "bad": {"before": "1"},
        "zero": {"number": 0, "pull_request": {"base": side("b", "o/r"), "head": side("h", "o/r")}},
    }
    for name, event in given.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(event, indent=1))
    good, bad = records.events(spark, str(tmp_path), "o/r")
    got = {r.file.rsplit("/", 1)[1]: (r.base, r.head, r.number, r.same_repository) for r in good.collect()}
    assert got == {"pull.json": ("b", "h", 7, True), "fork.json": ("b", "h", 8, False), "push.json": ("1", "2", None, False)}
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"bad.json", "zero.json"}


def test_corpus_and_evaluation_json(spark, tmp_path):
    case = lambda i, tier, **more: {"id": i, "repository_id": "r", "duplicate_group": i, "sequence": 1, "language": "python", "policy_packs": [], "sampling_stratum": "representative", "split": "development", "labels": [{"reviewer_id": "x", "tier": tier}, {"reviewer_id": "y", "tier": tier}], "resolved_tier": tier} | more
    result = {"score": 9.0, "classification": "high", "changed_files": [{"additions": 3, "deletions": 1}], "findings": [{"rule_id": "a"}, {"rule_id": "b"}], "limitations": ["Ownership x"]}
    rows = [case("one", "intensive", status="complete", result=result), case("two", "routine", status="unavailable", reason="other")]
    (tmp_path / "corpus.json").write_text("\n".join(map(json.dumps, rows)))
    cases, labels, findings, limitations = records.corpus(spark, str(tmp_path / "corpus.json"))
    assert {(r.case_id, r.files, r.lines) for r in cases.collect()} == {("one", 1, 4), ("two", None, None)}
    assert {(r.case_id, r.left_tier, r.resolved, r.insufficient) for r in labels.collect()} == {("one", 2, 2, False), ("two", 0, 0, False)}
    assert findings.count() == 2 and limitations.count() == 1
    texts = [json.loads(r.json) for r in outputs.evaluation_json(evaluation.evaluate(cases, labels)).collect()]
    assert [(t["scope"], t["cases"], t["exact"]) for t in texts] == [("change-size", 1, 1), ("cohort", 2, 1), ("language", 2, 1)]


def test_ci_outputs(tmp_path):
    report, out = tmp_path / "r.json", tmp_path / "out"
    outputs.ci_outputs({"classification": "low", "score": 5.0}, str(report), str(out))
    assert json.loads(report.read_text()) == {"classification": "low", "score": 5} and stat.S_IMODE(report.stat().st_mode) == 0o600
    assert out.read_text() == f"classification=low\nscore=5\njson-path={report}\n"


def test_blast_radius_is_consistent(spark):
    nodes = spark.createDataFrame([(p,) for p in "abcd"], "path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    n, e, t = graph.blast_radius(nodes, edges, spark.createDataFrame([(1, "a"), (1, "zz"), (2, "c")], "change_id int, path string"))
    assert checks.blast_radius(n, e, t).count() == 0
    assert {r.check for r in checks.blast_radius(n.where("path <> 'd'").union(n.where("path = 'a'")), e, t).collect()} >= {"duplicate-node", "edge-without-node"}
