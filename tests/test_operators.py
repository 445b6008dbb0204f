from __future__ import annotations

import pytest
from faultline.functions.classify import categories
from faultline.operators import checks, coverage, evaluation, graph, relations, rules, scoring

API, UI, SERVICE, CORE = "packages/app/api.ts", "packages/app/ui.ts", "packages/service/index.ts", "packages/core/index.ts"
EDGES = [(API, SERVICE), (UI, SERVICE), (SERVICE, CORE), (SERVICE, CORE)]


def make(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "path string"), spark.createDataFrame(edges, "src string, dst string")


def test_graph_goldens(spark):
    nodes, edges = make(spark, [API, UI, SERVICE, CORE], EDGES)
    edges = graph.construct(nodes, edges)
    assert edges.count() == 3
    assert {r.path: (r.fan_in, r.fan_out) for r in graph.metrics(nodes, edges).collect()} == {API: (0, 1), UI: (0, 1), CORE: (1, 0), SERVICE: (2, 1)}
    seed = spark.createDataFrame([(CORE,)], "path string")
    found, cut = graph.transitive_dependents(edges, seed, 2)
    assert {(r.dependent, r.distance) for r in found.collect()} == {(SERVICE, 1), (API, 2), (UI, 2)} and cut.count() == 0
    found, cut = graph.transitive_dependents(edges, seed, 1)
    assert [r.dependent for r in found.collect()] == [SERVICE] and [r.seed for r in cut.collect()] == [CORE]
    crossed = graph.boundary_crossings(edges, {k: f"packages/{k}" for k in ("app", "service", "core")})
    assert {(r.src_package, r.dst_package) for r in crossed.collect()} == {("app", "service"), ("service", "core")} and crossed.count() == 3
    for bad in (0, 101):
        with pytest.raises(ValueError):
            graph.transitive_dependents(edges, seed, bad)
    with pytest.raises(ValueError):
        graph.construct(nodes, edges.union(spark.createDataFrame([("x", "y")], "src string, dst string")))
    with pytest.raises(ValueError):
        graph.construct(nodes.union(nodes), edges)


def test_components(spark):
    nodes, edges = make(spark, ["a", "b", "self", "standalone"], [("a", "b"), ("b", "a"), ("self", "self")])
    found = graph.scc(nodes, edges)
    assert {r.path: r.component for r in found.collect()} == {"a": "a", "b": "a", "self": "self", "standalone": "standalone"}
    assert sorted(r.members for r in graph.cycles(found, edges).collect()) == [["a", "b"], ["self"]]


def test_components_against_reachability(spark):
    import random

    rng = random.Random(8)
    names = [f"n{i:02}" for i in range(30)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            for n in names:
                if a in reach[n]:
                    reach[n].add(b)
    want = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    nodes, edges = make(spark, names, sorted(pairs))
    assert {r.path: r.component for r in graph.scc(nodes, edges).collect()} == want


def blast(spark, **limits):
    nodes, edges = make(spark, ["app.ts", "core.ts", "feature.ts", "unrelated.ts"], [("app.ts", "feature.ts"), ("feature.ts", "core.ts")])
    changed = spark.createDataFrame([(1, "missing.ts"), (1, "core.ts")], "change_id int, path string")
    n, e, t = graph.blast_radius(nodes, edges, changed, **limits)
    total = t.collect()[0]
    return {(r.path, r.distance, r.fan_in, r.fan_out) for r in n.collect()}, {(r.src, r.dst) for r in e.collect()}, total


def test_blast_radius(spark):
    nodes, edges, total = blast(spark, max_depth=3)
    assert nodes == {("core.ts", 0, 1, 0), ("feature.ts", 1, 1, 1), ("app.ts", 2, 0, 1)} and len(edges) == 2
    assert (total.graph_nodes, total.graph_edges, total.changed, total.unindexed, total.truncated) == (4, 2, 2, ["missing.ts"], False)
    assert blast(spark, max_depth=1)[2].truncated
    nodes, _, total = blast(spark, max_depth=3, max_nodes=2)
    assert {n[0] for n in nodes} == {"core.ts", "feature.ts"} and total.truncated
    assert blast(spark, max_edges=1)[2].truncated


def findings(spark, rows):
    return spark.createDataFrame([(1, r, f"{r}:{k}:finding", float(w)) for r, k, w in rows], "change_id int, rule_id string, finding_id string, weight double")


@pytest.mark.parametrize(
    "rows,score,name,weights",
    [
        ([("z", 1, 30), ("a", 1, 15), ("a", 2, 15)], 60, "high", {"a": 30, "z": 30}),
        ([("large", 1, 20), ("tests", 1, -10)], 10, "low", {"large": 20, "tests": -10}),
        ([("tests", 1, -10)], 0, "low", {"tests": 0}),
        ([("a", 1, -30), ("b", 1, 20), ("c", 1, -30)], 0, "low", {"a": -20, "b": 20, "c": 0}),
    ],
)
def test_scores(spark, rows, score, name, weights):
    contributed = scoring.contributions(findings(spark, rows))
    assert {r.rule_id: r.weight for r in contributed.collect()} == weights
    out = scoring.scores(spark.createDataFrame([(1,), (2,)], "change_id int"), contributed).orderBy("change_id").collect()
    assert (out[0].score, out[0].classification) == (score, name) and (out[1].score, out[1].classification) == (0, "low")


def test_capped_mitigation_matches_a_loop(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for change in range(60):
        own = [(f"r{k}", rng.choice([-30, -10, 5, 20, 25])) for k in range(rng.randint(1, 7))]
        left = sum(max(w, 0) for _, w in own)
        for rule, w in own:
            eff = max(w, -left) if w < 0 else w
            left += min(eff, 0)
            want[change, rule] = eff
            rows.append((change, rule, f"{rule}:1:finding", float(w)))
    df = spark.createDataFrame(rows, "change_id int, rule_id string, finding_id string, weight double")
    assert {(r.change_id, r.rule_id): r.weight for r in scoring.contributions(df).collect()} == want


def test_changed_line_coverage(spark):
    ranges = spark.createDataFrame([(1, "a.ts", 1, 2), (1, "a.ts", 4, 2), (1, "missing.ts", 3, 1)], "change_id int, path string, start int, span int")
    lines = spark.createDataFrame([("a.ts", 1, 2), ("a.ts", 2, 0), ("a.ts", 4, 1), ("pure-delete.ts", 9, 1)], "path string, line int, hits int")
    presence = spark.createDataFrame([(1, p) for p in ("a.ts", "missing.ts", "pure-delete.ts")], "change_id int, path string")
    got = {r.path: (r.changed, r.found, r.hit) for r in coverage.changed_lines(ranges, lines, presence).collect()}
    assert got == {"a.ts": (4, 3, 2), "missing.ts": (1, None, None), "pure-delete.ts": (0, 0, 0)}


REL = "change_id int, path string, lines_found int, lines_hit int, has_baseline boolean, baseline_found int, baseline_hit int, has_changed boolean, changed_count int, changed_found int, changed_hit int"


def test_coverage_concerns(spark):
    rows = [
        (1, "below", 2, 1, False, None, None, False, None, None, None), (1, "missing", None, None, False, None, None, False, None, None, None),
        (1, "none", 0, 0, False, None, None, False, None, None, None), (1, "at", 10, 8, False, None, None, False, None, None, None),
        (1, "regressed", 10, 8, True, 10, 9, False, None, None, None), (1, "improved", 10, 9, True, 10, 8, False, None, None, None),
        (1, "unmeasured", 10, 9, True, None, None, True, 3, 0, 0), (1, "changed", 10, 9, False, None, None, True, 4, 3, 2), (1, "untouched", 10, 9, False, None, None, True, 0, 0, 0),
    ]
    got = {r.path: (r.reasons, r.line_percent, r.delta) for r in coverage.concerns(spark.createDataFrame(rows, REL)).collect()}
    assert got == {
        "below": (["below-threshold"], 50, None), "missing": (["missing-record"], None, None), "none": (["no-measurable-lines"], None, None),
        "regressed": (["coverage-regression"], 80, -10), "unmeasured": (["no-measurable-changed-lines"], 90, None), "changed": (["below-changed-line-threshold"], 90, None),
    }
    assert "regressed" not in {r.path for r in coverage.concerns(spark.createDataFrame(rows, REL), 70, 70, 10).collect()}


def test_relationships(spark):
    modules = spark.createDataFrame([(p,) for p in ("packages/api/src/auth.ts", "packages/api/test/auth.spec.ts", "src/billing.ts", "src/billing.test.ts", "src/no-test.ts")], "path string")
    got = {r.source_path: r.test_paths for r in relations.test_relationships(modules).collect()}
    assert got == {"packages/api/src/auth.ts": ["packages/api/test/auth.spec.ts"], "src/billing.ts": ["src/billing.test.ts"], "src/no-test.ts": []}


def test_exports(spark):
    rows = [(1, s, "src/index.ts", n, g) for s, n, g in (("base", "changed", "string"), ("head", "changed", "number"), ("base", "removed", "x"), ("head", "added", "y"), ("base", "alias", "z"), ("head", "alias", "z"))]
    got = relations.export_changes(spark.createDataFrame(rows, "change_id int, side string, path string, name string, signature string"))
    assert {(r.name, r.change) for r in got.collect()} == {("added", "added"), ("changed", "modified"), ("removed", "removed")}


def files(spark, rows):
    return spark.createDataFrame([(1, p, s, a, 0) for p, s, a in rows], "change_id int, path string, status string, additions long, deletions long").withColumn("categories", categories("path"))


def test_end_to_end_score(spark):
    changed = files(spark, [("src/auth.ts", "modified", 1), ("src/auth.test.ts", "added", 5), ("src/index.ts", "modified", 1)])
    tests = relations.test_relationships(changed.select("path"))
    exported = spark.createDataFrame([(1, "src/index.ts", "publicApi", "modified")], "change_id int, path string, name string, change string")
    found = rules.evaluate(rules.Facts(changed, tests=tests, exports=exported))
    assert sorted(r.finding_id for r in found.collect()) == ["missing-related-tests:1:finding", "public-export:1:finding", "tests-added:1:finding"]
    out = scoring.scores(changed.select("change_id"), scoring.contributions(found)).collect()
    assert [(r.score, r.classification) for r in out] == [(35, "moderate")]
    only = rules.evaluate(rules.Facts(changed, exports=exported))
    assert [r.rule_id for r in only.collect()] == ["public-export"]


def test_engine_checks(spark):
    facts = rules.Facts(files(spark, [("a.ts", "added", 900)]))
    assert rules.evaluate(facts, settings={"large-change": rules.Setting(enabled=False)}).count() == 0
    assert [r.weight for r in rules.evaluate(facts, settings={"large-change": rules.Setting(weight=7)}).collect()] == [7]
    for bad in ({"nope": rules.Setting()}, {"large-change": rules.Setting(options={"maxFiles": 0})}, {"large-change": rules.Setting(weight=float("inf"))}):
        with pytest.raises(ValueError):
            rules.evaluate(facts, settings=bad)
    with pytest.raises(ValueError):
        rules.evaluate(facts, (rules.DEFAULT_RULES[0], rules.DEFAULT_RULES[0]))


CASES = "case_id string, repository_id int, language string, split string, stratum string, sequence_no int, duplicate_group int, status string, reason string, score double, classification string, files long, lines long"


def test_cohort_golden(spark):
    rows = [
        ("a", 1, "typescript", "development", "representative", 1, 1, "complete", None, 1.0, "moderate", 1, 10), ("b", 1, "typescript", "development", "representative", 2, 2, "complete", None, 8.0, "low", 6, 120),
        ("c", 2, "python", "development", "representative", 1, 3, "complete", None, 15.0, "critical", 21, 600), ("d", 1, "typescript", "development", "representative", 3, 4, "unavailable", "revision-unavailable", None, None, None, None),
    ]
    cases = spark.createDataFrame(rows, CASES)
    labels = spark.createDataFrame([("a", 0, 0, 0, False), ("b", 1, 2, 2, False), ("c", 0, 3, 3, False), ("d", None, 1, None, True)], "case_id string, left_tier int, right_tier int, resolved int, insufficient boolean")
    seg = evaluation.segmented(cases, labels)
    pick = lambda df: df.where("scope = 'cohort'").collect()
    wide = pick(evaluation.evaluate(cases, labels))[0]
    assert (wide.cases, wide.analyzable, wide.insufficient, wide.evaluated, wide.comparison) == (4, 3, 1, 3, "insufficient")
    assert (wide.exact, wide.within_one, wide.under_two, wide.over_one, wide.pairs, wide.pairs_exact, wide.pairs_within_one) == (1, 2, 1, 1, 3, 1, 2)
    assert abs(wide.spearman - 1) < 1e-9 and abs(wide.pairs_kappa - 0.0625) < 1e-9
    matrix = {(r.resolved, r.actual): r.n for r in pick(evaluation.confusion(seg)) if r.n}
    assert matrix == {(0, 1): 1, (2, 0): 1, (3, 3): 1}
    found = spark.createDataFrame([("a", "large-change"), ("b", "large-change"), ("b", "sensitive-path"), ("c", "sensitive-path")], "case_id string, rule_id string")
    assert {(r.rule_id, r.cases, r.findings) for r in pick(evaluation.finding_prevalence(seg, found))} == {("large-change", 2, 2), ("sensitive-path", 2, 2)}
    assert [(r.left_rule, r.right_rule, r.cases) for r in pick(evaluation.cooccurrence(seg, found))] == [("large-change", "sensitive-path", 1)]
    limits = spark.createDataFrame([("a", "Ownership…"), ("b", "unrecognised"), ("c", "Language analysis…"), ("c", "Revision source reads…")], "case_id string, limitation string")
    assert {r.category: r.n for r in pick(evaluation.limitation_prevalence(seg, limits)) if r.n} == {"ownership": 1, "other": 1, "language-index": 1, "public-surface": 1}
    assert {r.reason: r.n for r in pick(evaluation.unavailable(seg)) if r.n} == {"revision-unavailable": 1}
    assert checks.corpus(cases, labels).count() == 0
    assert {r.check for r in checks.corpus(cases.union(cases), labels).collect()} >= {"duplicate-case", "duplicate-sequence"}
    assert {(r.check, r.key) for r in checks.corpus(cases, labels.where("case_id <> 'a'")).collect()} == {("case-without-label", "a")}


def test_integrity(spark):
    found = findings(spark, [("a", 1, 5), ("b", 1, 5)])
    contributed = scoring.contributions(found)
    scores = scoring.scores(found, contributed)
    assert checks.result_integrity(found, contributed, scores).count() == 0
    assert {r.check for r in checks.result_integrity(found, contributed.where("rule_id = 'a'"), scores).collect()} == {"finding-without-contribution", "score-differs"}


def test_components_of_a_long_chain(spark):
    """A chain of 5,000 nodes takes seconds, in one task and beyond; the cycle at its end is one component."""
    import time

    n = 5_000
    edges = [(f"n{i:05}", f"n{i + 1:05}") for i in range(n - 1)] + [(f"n{n - 1:05}", f"n{n - 5:05}"), ("n00007", "n00007")]
    nodes = spark.createDataFrame([(f"n{i:05}",) for i in range(n)] + [("alone",)], "path string")
    began = time.time()
    got = {r.path: r.component for r in graph.scc(nodes, spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert time.time() - began < 60
    last = {f"n{i:05}": f"n{n - 5:05}" for i in range(n - 5, n)}
    assert got == {f"n{i:05}": f"n{i:05}" for i in range(n - 5)} | last | {"alone": "alone"}


def test_components_of_large_graphs_match_one_task(spark):
    import random

    rng = random.Random(3)
    edges = [(f"a{rng.randrange(30)}", f"a{rng.randrange(30)}") for _ in range(45)] + [(f"b{i}", f"b{(i + 1) % 6}") for i in range(6)] + [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c4", "c4")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(p,) for p in sorted({x for e in edges for x in e} | {"z"})], "path string")
    run = lambda most: {r.path: r.component for r in graph.scc(nodes, frame, most).collect()}
    whole = run(1_000)
    assert run(10) == whole  # some weak components in a task each, the large one coloured
    assert whole["b3"] == "b0" and whole["c2"] == "c1" and whole["z"] == "z"


def test_ranges_are_looked_up_in_sorted_lines(spark):
    import random

    rng = random.Random(5)
    lines = [(p, k, rng.randint(0, 1)) for p in "ab" for k in sorted(rng.sample(range(1, 400), 120))]
    ranges = [(c, rng.choice("abc"), rng.randint(1, 420), rng.randint(0, 90)) for c in range(60)]
    out = coverage.changed_lines(spark.createDataFrame(ranges, "change_id int, path string, start long, span long"), spark.createDataFrame(lines, "path string, line long, hits long"))
    got = {r.change_id: (r.path, r.changed, r.found, r.hit) for r in out.collect()}
    for c, p, start, span in ranges:
        if span:
            inside = [h for q, k, h in lines if q == p and start <= k < start + span]
            assert got.pop(c) == (p, span, None if p == "c" else len(inside), None if p == "c" else sum(h > 0 for h in inside))
    assert not got
