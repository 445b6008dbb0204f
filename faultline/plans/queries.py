"""The engine's operators as queries over facts derived from the star schema.

Each query has an oracle: the same result as SQL that DuckDB runs on the same
tables. Options are fixed where the derived facts would leave a rule silent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, paths, patterns, stats
from ..operators import checks, coverage, evaluation, graph, ownership, relations, rules, scoring
from ..sources.bridge import fact, with_clause
from .cut import cut

AREAS = {"authentication": ["**/auth/**", "**/auth.*"], "database": ["migrations/**", "**/*.sql"], "release": ["terraform/q?/**", "docs/**/package.json"]}
OWNERS: list[ownership.Rule] = [
    ("*.ts", ["@typescript"]),
    ("/docs/", ["@docs"]),
    ("src/auth/*.ts", ["@auth", "@org/security"]),
    ("migrations/*/package.json", ["@data"]),
    ("__tests__", ["@quality"]),
    ("/terraform/q*", []),
    ("packages/**/index.ts", ["@api"]),
]
ROOTS = {"auth": "src/auth", "core": "src/core", "api": "packages/api/src", "terraform": "terraform"}
FAN_IN, DEPTH = 2, 4
SETTINGS = {
    "high-fan-in": rules.Setting(options={"minFanIn": FAN_IN, "maxTraversalDepth": DEPTH}),
    "large-change": rules.Setting(options={"maxFiles": 6, "maxLines": 500}),
    "multi-area-change": rules.Setting(options={"minAreas": 3}),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, *facts: str):
    """Register a query, with its oracle over the named facts."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            body = oracle.strip()
            head = with_clause(*facts) if facts else ""
            ORACLES[f.__name__] = f"{head}, {body[5:]}" if head and body.upper().startswith("WITH ") else f"{head} {body}"
        return f

    return register


def text(array):
    """Arrays leave queries as comma-joined text."""
    return F.array_join(array, ",")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fact(spark, sf_dir, "changed_files").withColumn("categories", classify.categories("path"))


def _case(pattern: str) -> str:
    return f"regexp_matches(lower(path), '{pattern}')"


CATS = "list_filter([" + ", ".join(f"CASE WHEN {_case(p)} THEN '{c}' END" for c, p in classify.tests().items()) + "], lambda x: x IS NOT NULL)"
FILES = f"files AS (SELECT *, CASE WHEN len({CATS}) = 0 THEN ['other'] ELSE {CATS} END AS categories FROM changed_files)"
HAS = lambda c: f"list_contains(categories, '{c}')"
AREA = "CASE WHEN strpos(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '(root)' END"


@query(f"WITH {FILES} SELECT change_id, path, array_to_string(categories, ',') AS categories FROM files", "changed_files")
def classify_files(spark, sf_dir):
    return files(spark, sf_dir).select("change_id", "path", text("categories").alias("categories"))


PY = "list_filter([" + ", ".join(f"CASE WHEN {_case(p)} THEN '{c}' END" for c, p in classify.tests("python").items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT path, array_to_string(CASE WHEN len({PY}) = 0 THEN ['other'] ELSE {PY} END, ',') AS categories FROM modules", "modules")
def classify_python(spark, sf_dir):
    return fact(spark, sf_dir, "modules").select("path", text(classify.categories("path", "python")).alias("categories"))


@query(f"WITH {FILES} SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM files) GROUP BY category", "changed_files")
def category_counts(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT change_id, count(*) AS files, CAST(sum(additions + deletions) AS BIGINT) AS lines FROM changed_files GROUP BY change_id", "changed_files")
def change_totals(spark, sf_dir):
    return rules.shape(files(spark, sf_dir)).select("change_id", "files", "lines")


@query(f"SELECT change_id, string_agg(DISTINCT area, ',' ORDER BY area) AS areas FROM (SELECT change_id, {AREA} AS area FROM changed_files) GROUP BY change_id", "changed_files")
def change_areas(spark, sf_dir):
    return rules.shape(files(spark, sf_dir)).select("change_id", text("areas").alias("areas"))


@query("""SELECT change_id, CASE WHEN files <= 5 AND lines <= 100 THEN 'small' WHEN files <= 20 AND lines <= 500 THEN 'medium' ELSE 'large' END AS size FROM case_totals""", "case_totals")
def change_size(spark, sf_dir):
    return fact(spark, sf_dir, "case_totals").select("change_id", stats.change_size(F.col("files"), F.col("lines")).alias("size"))


@query(f"SELECT path FROM modules WHERE regexp_matches(path, '{paths.ENTRY_POINT}')", "modules")
def entry_points(spark, sf_dir):
    return fact(spark, sf_dir, "modules").where(paths.is_entry_point("path")).select("path")


IGNORED = ["**/__tests__/**", "docs/**", "**/*.generated.ts", "terraform/q?/*"]


@query("SELECT path FROM modules WHERE NOT (" + " OR ".join(f"regexp_matches(path, '{patterns.glob_regex(p)}')" for p in IGNORED) + ")", "modules")
def ignore_filter(spark, sf_dir):
    return ownership.ignore(fact(spark, sf_dir, "modules"), IGNORED).select("path")


def _rule(rule_id: str, spark, sf_dir) -> DataFrame:
    """One rule's matches as flat rows."""
    rule = next(r for r in rules.DEFAULT_RULES if r.id == rule_id)
    found = rules.evaluate(facts(spark, sf_dir), (rule,), {k: v for k, v in SETTINGS.items() if k == rule_id})
    return found.select("change_id", "finding_id", "severity", text("paths").alias("paths"))


def facts(spark, sf_dir, shared: bool = False) -> rules.Facts:
    """``shared`` writes the classified files once, for all rules to read."""
    made: dict[str, DataFrame] = {}
    changed = fact(spark, sf_dir, "changed_files", made).withColumn("categories", classify.categories("path"))
    changed = cut(changed) if shared else changed
    modules, edges = fact(spark, sf_dir, "modules", made), fact(spark, sf_dir, "graph_edges", made)
    owned = changed.select("change_id", "path").join(ownership.match(modules, OWNERS), "path")
    exports = relations.export_changes(fact(spark, sf_dir, "exports", made))
    return rules.Facts(changed, modules.select("path"), edges, relations.test_relationships(modules), owned, exports, coverage_relation(spark, sf_dir, changed, made), AREAS)


def coverage_lines(records: DataFrame) -> DataFrame:
    return records.where("lines_found > 0").select("path", "lines_hit", F.explode(F.sequence(F.lit(1).cast("long"), "lines_found")).alias("line")).select("path", "line", (F.col("line") <= F.col("lines_hit")).cast("long").alias("hits")).unionByName(
        records.where("lines_found = 0").select("path", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("hits"))
    )


def coverage_relation(spark, sf_dir, changed: DataFrame, made: dict) -> DataFrame:
    records = fact(spark, sf_dir, "coverage_records", made)
    eligible = coverage.eligible(changed)
    base = coverage.with_baseline(eligible, fact(spark, sf_dir, "coverage_baseline", made))
    lines = coverage.changed_lines(fact(spark, sf_dir, "changed_ranges", made), coverage_lines(records))
    out = coverage.with_records(eligible, records).join(base, ["change_id", "path"]).join(lines, ["change_id", "path"], "left")
    return out.select("change_id", "path", "lines_found", "lines_hit", F.lit(True).alias("has_baseline"), "baseline_found", "baseline_hit", F.lit(True).alias("has_changed"), F.col("changed").alias("changed_count"), F.col("found").alias("changed_found"), F.col("hit").alias("changed_hit"))


def _listed(where: str, rule_id: str, severity: str) -> str:
    return f"SELECT change_id, '{rule_id}:1:finding' AS finding_id, '{severity}' AS severity, string_agg(path, ',' ORDER BY path) AS paths FROM files WHERE {where} GROUP BY change_id"


R1, R3, R6 = _listed(HAS("dependency"), "dependency-manifest", "medium"), _listed(f"{HAS('infrastructure')} OR {HAS('ci')}", "infrastructure", "high"), _listed(HAS("migration"), "migration", "high")
R5 = "SELECT change_id, 'large-change:1:finding' AS finding_id, CASE WHEN count(*) > 12 OR sum(additions + deletions) > 1000 THEN 'high' ELSE 'medium' END AS severity, string_agg(path, ',' ORDER BY path) AS paths FROM files GROUP BY change_id HAVING count(*) > 6 OR sum(additions + deletions) > 500"
R9 = f"SELECT change_id, 'multi-area-change:1:finding' AS finding_id, 'medium' AS severity, string_agg(path, ',' ORDER BY path) AS paths FROM files GROUP BY change_id HAVING count(DISTINCT {AREA}) >= 3"
_areas = " UNION ALL ".join(f"SELECT change_id, path, '{a}' AS area FROM files WHERE " + " OR ".join(f"regexp_matches(path, '{patterns.glob_regex(p)}')" for p in ps) for a, ps in sorted(AREAS.items()))
R11 = f"SELECT change_id, concat('sensitive-path:', row_number() OVER (PARTITION BY change_id ORDER BY area), ':finding') AS finding_id, 'high' AS severity, paths FROM (SELECT change_id, area, string_agg(path, ',' ORDER BY path) AS paths FROM ({_areas}) GROUP BY change_id, area)"
_compiled = ownership.compile_rules(OWNERS)
OWNED = "owned AS (SELECT path, CASE " + " ".join(f"WHEN regexp_matches(path, '{r}') THEN '{','.join(o)}'" for _, r, o in reversed(_compiled)) + " ELSE '' END AS owners FROM modules)"
R7 = "SELECT change_id, 'missing-owner:1:finding' AS finding_id, 'medium' AS severity, string_agg(path, ',' ORDER BY path) AS paths FROM files JOIN owned USING (path) WHERE owners = '' GROUP BY change_id"


def _register_rule(name: str, rule_id: str, sql: str, *names: str) -> None:
    def run(spark, sf_dir):
        return _rule(rule_id, spark, sf_dir)

    run.__name__ = name
    query(sql, *names)(run)


for _name, _id, _sql in (("dependency_manifest", "dependency-manifest", R1), ("infrastructure", "infrastructure", R3), ("migration", "migration", R6), ("large_change", "large-change", R5), ("multi_area", "multi-area-change", R9), ("sensitive_path", "sensitive-path", R11)):
    _register_rule(_name, _id, f"WITH {FILES} {_sql}", "changed_files")
_register_rule("missing_owner", "missing-owner", f"WITH {FILES}, {OWNED} {R7}", "changed_files")


@query(f"WITH {OWNED} SELECT path, owners FROM owned", "modules")
def ownership_match(spark, sf_dir):
    return ownership.match(fact(spark, sf_dir, "modules"), OWNERS).select("path", text("owners").alias("owners"))


@query(f"WITH {OWNED} SELECT path, owners FROM owned", "modules")
def ownership_theta_join(spark, sf_dir):
    return ownership.match(fact(spark, sf_dir, "modules"), OWNERS, unrolled=0).select("path", text("owners").alias("owners"))


ELIGIBLE = f"eligible AS (SELECT * FROM files WHERE status <> 'deleted' AND {HAS('source')} AND NOT {HAS('test')} AND NOT {HAS('generated')})"


@query(f"WITH {FILES}, {ELIGIBLE} SELECT change_id, path, lines_found, lines_hit FROM eligible LEFT JOIN coverage_records USING (path)", "changed_files", "coverage_records")
def coverage_join(spark, sf_dir):
    return coverage.with_records(coverage.eligible(files(spark, sf_dir)), fact(spark, sf_dir, "coverage_records")).select("change_id", "path", "lines_found", "lines_hit")


@query(f"WITH {FILES}, {ELIGIBLE} SELECT change_id, e.path, e.path AS baseline_path, lines_found AS baseline_found, lines_hit AS baseline_hit FROM eligible e LEFT JOIN coverage_baseline b ON e.path = b.path", "changed_files", "coverage_baseline")
def coverage_baseline(spark, sf_dir):
    return coverage.with_baseline(coverage.eligible(files(spark, sf_dir)), fact(spark, sf_dir, "coverage_baseline")).select("change_id", "path", F.col("path").alias("baseline_path"), "baseline_found", "baseline_hit")


CHANGED = """changed_lines AS (SELECT change_id, path, span AS changed,
  CASE WHEN lines_found IS NOT NULL THEN greatest(0, least(start + span - 1, lines_found) - start + 1) END AS found,
  CASE WHEN lines_found IS NOT NULL THEN greatest(0, least(start + span - 1, lines_hit) - start + 1) END AS hit
  FROM changed_ranges LEFT JOIN coverage_records USING (path))"""


@query(f"WITH {CHANGED} SELECT change_id, path, changed, found, hit FROM changed_lines", "changed_ranges", "coverage_records")
def changed_line_coverage(spark, sf_dir):
    return coverage.changed_lines(fact(spark, sf_dir, "changed_ranges"), coverage_lines(fact(spark, sf_dir, "coverage_records"))).select("change_id", "path", "changed", "found", "hit")


CONCERNS = f"""concerns AS (SELECT * FROM (SELECT change_id, path, list_filter([
    CASE WHEN lines_found IS NULL THEN 'missing-record' WHEN lines_found = 0 THEN 'no-measurable-lines' WHEN lines_hit * 100.0 / lines_found < 80 THEN 'below-threshold' END,
    CASE WHEN lines_found > 0 AND base_found > 0 AND CAST(lines_hit AS DOUBLE) * 100 / lines_found - CAST(base_hit AS DOUBLE) * 100 / base_found < 0 THEN 'coverage-regression' END,
    CASE WHEN lines_found IS NOT NULL AND changed > 0 AND found = 0 THEN 'no-measurable-changed-lines' WHEN lines_found IS NOT NULL AND changed > 0 AND found > 0 AND CAST(hit AS DOUBLE) * 100 / found < 80 THEN 'below-changed-line-threshold' END], lambda x: x IS NOT NULL) AS reasons,
    CASE WHEN lines_found > 0 THEN floor(CAST(lines_hit AS DOUBLE) * 100 / lines_found * 100 + 0.5) / 100 END AS line_percent
  FROM eligible e LEFT JOIN coverage_records USING (path) LEFT JOIN (SELECT path, lines_found AS base_found, lines_hit AS base_hit FROM coverage_baseline) b USING (path) LEFT JOIN changed_lines c USING (change_id, path)) WHERE len(reasons) > 0)"""


@query(f"WITH {FILES}, {ELIGIBLE}, {CHANGED}, {CONCERNS} SELECT change_id, path, array_to_string(reasons, ',') AS reasons, line_percent FROM concerns", "changed_files", "coverage_records", "coverage_baseline", "changed_ranges")
def coverage_concerns(spark, sf_dir):
    found = coverage.concerns(coverage_relation(spark, sf_dir, files(spark, sf_dir), {}))
    return found.select("change_id", "path", text("reasons").alias("reasons"), "line_percent")


R4 = "SELECT change_id, 'insufficient-coverage:1:finding' AS finding_id, 'medium' AS severity, string_agg(path, ',' ORDER BY path) AS paths FROM concerns GROUP BY change_id"
_register_rule("insufficient_coverage", "insufficient-coverage", f"WITH {FILES}, {ELIGIBLE}, {CHANGED}, {CONCERNS} {R4}", "changed_files", "coverage_records", "coverage_baseline", "changed_ranges")

_key = f"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(path, '{paths.TS_EXTENSION}', ''), '{paths.TS_MARK}', ''), '/'), lambda s: s NOT IN ({', '.join(repr(s) for s in paths.TS_SEGMENTS)})), '/')"
TESTS = f"""keyed AS (SELECT path, {_key} AS key, regexp_matches(path, '{paths.TEST_MODULE['typescript']}') AS is_test FROM modules),
  pairs AS (SELECT s.path AS source_path, t.path AS test_path FROM keyed s LEFT JOIN keyed t ON s.key = t.key AND t.is_test WHERE NOT s.is_test)"""


@query(f"WITH {TESTS} SELECT source_path, coalesce(string_agg(test_path, ',' ORDER BY test_path), '') AS test_paths FROM pairs GROUP BY source_path", "modules")
def test_relationships(spark, sf_dir):
    return relations.test_relationships(fact(spark, sf_dir, "modules")).select("source_path", text("test_paths").alias("test_paths"))


_py_key = f"regexp_replace(path, '{paths.PY_EXTENSION}', '')"


@query(
    f"""SELECT path AS source_path, array_to_string(list_filter(list_concat(list_filter(string_split({_py_key}, '/')[:-2], lambda s: s NOT IN ('src', 'tests')),
    [regexp_replace(regexp_replace(string_split({_py_key}, '/')[-1], '^test_', ''), '_test\\z', '')]), lambda s: s <> ''), '/') AS key FROM modules WHERE path LIKE '%.py'""",
    "modules",
)
def python_test_keys(spark, sf_dir):
    return fact(spark, sf_dir, "modules").where("path LIKE '%.py'").select(F.col("path").alias("source_path"), paths.test_key("path", "python").alias("key"))


SOURCES = f"sources AS (SELECT change_id, path AS source_path FROM files WHERE {HAS('source')} AND NOT {HAS('test')})"
R8 = f"""SELECT change_id, concat('missing-related-tests:', row_number() OVER (PARTITION BY change_id ORDER BY source_path), ':finding') AS finding_id, 'medium' AS severity, paths FROM (
  SELECT s.change_id, s.source_path, array_to_string(list_sort(list_distinct(list_append(list(p.test_path) FILTER (WHERE p.test_path IS NOT NULL), s.source_path))), ',') AS paths, count(f.path) AS touched
  FROM sources s JOIN pairs p USING (source_path) LEFT JOIN files f ON f.change_id = s.change_id AND f.path = p.test_path AND f.status <> 'deleted' AND {HAS('test').replace('categories', 'f.categories')}
  GROUP BY s.change_id, s.source_path) WHERE touched = 0"""
R12 = f"""SELECT change_id, 'tests-added:1:finding' AS finding_id, 'info' AS severity, array_to_string(list_sort(list_distinct(list_concat(list(source_path), list(test_path)))), ',') AS paths
  FROM (SELECT s.change_id, s.source_path, p.test_path FROM sources s JOIN pairs p USING (source_path) JOIN files f ON f.change_id = s.change_id AND f.path = p.test_path AND f.status = 'added' AND {HAS('test').replace('categories', 'f.categories')}) GROUP BY change_id"""
_register_rule("missing_related_tests", "missing-related-tests", f"WITH {FILES}, {TESTS}, {SOURCES} {R8}", "changed_files", "modules")
_register_rule("tests_added", "tests-added", f"WITH {FILES}, {TESTS}, {SOURCES} {R12}", "changed_files", "modules")

METRICS = """metrics AS (SELECT m.path, count(DISTINCT i.src) AS fan_in, count(DISTINCT o.dst) AS fan_out FROM modules m LEFT JOIN graph_edges i ON i.dst = m.path LEFT JOIN graph_edges o ON o.src = m.path GROUP BY m.path)"""


@query(f"WITH {METRICS} SELECT path, fan_in, fan_out FROM metrics", "modules", "graph_edges")
def graph_metrics(spark, sf_dir):
    return graph.metrics(fact(spark, sf_dir, "modules"), fact(spark, sf_dir, "graph_edges"))


@query(f"WITH {METRICS} SELECT m.path AS seed, e.src AS dependent FROM metrics m JOIN graph_edges e ON e.dst = m.path WHERE fan_in >= {FAN_IN}", "modules", "graph_edges")
def direct_dependents(spark, sf_dir):
    nodes, edges = fact(spark, sf_dir, "modules"), fact(spark, sf_dir, "graph_edges")
    return graph.direct_dependents(edges, graph.metrics(nodes, edges).where(F.col("fan_in") >= FAN_IN))


REACH = f"""metrics AS (SELECT m.path, count(DISTINCT i.src) AS fan_in FROM modules m LEFT JOIN graph_edges i ON i.dst = m.path GROUP BY m.path),
  walk(seed, node, distance) AS (SELECT path, path, 0 FROM metrics WHERE fan_in >= {FAN_IN} UNION SELECT w.seed, e.src, w.distance + 1 FROM walk w JOIN graph_edges e ON e.dst = w.node WHERE w.distance < {DEPTH + 1}),
  reached AS (SELECT seed, node AS dependent, min(distance) AS distance FROM walk GROUP BY seed, node HAVING min(distance) > 0)"""


def _recursive(sql: str, *names: str) -> str:
    return with_clause(*names).replace("WITH ", "WITH RECURSIVE ", 1) + ", " + sql


@query()
def transitive_dependents(spark, sf_dir):
    nodes, edges = fact(spark, sf_dir, "modules"), fact(spark, sf_dir, "graph_edges")
    return graph.transitive_dependents(edges, graph.metrics(nodes, edges).where(F.col("fan_in") >= FAN_IN), DEPTH)[0]


ORACLES["transitive_dependents"] = _recursive(f"{REACH} SELECT seed, dependent, distance FROM reached WHERE distance <= {DEPTH}", "modules", "graph_edges")


def _high_fan_in(spark, sf_dir):
    return _rule("high-fan-in", spark, sf_dir)


_high_fan_in.__name__ = "high_fan_in"
query()(_high_fan_in)
R2 = f"""SELECT change_id, concat('high-fan-in:', row_number() OVER (PARTITION BY change_id ORDER BY path), ':finding') AS finding_id, CASE WHEN n >= {2 * FAN_IN} THEN 'high' ELSE 'medium' END AS severity, paths
  FROM changed_files JOIN (SELECT m.path, count(r.dependent) AS n, array_to_string(list_sort(list_append(list(r.dependent) FILTER (WHERE r.dependent IS NOT NULL), m.path)), ',') AS paths
    FROM metrics m LEFT JOIN (SELECT * FROM reached WHERE distance <= {DEPTH}) r ON r.seed = m.path WHERE m.fan_in >= {FAN_IN} GROUP BY m.path) USING (path)"""
ORACLES["high_fan_in"] = _recursive(f"{REACH} {R2}", "modules", "graph_edges", "changed_files")

_closure = "walk(a, b, d) AS (SELECT path, path, 0 FROM modules UNION SELECT w.a, e.dst, w.d + 1 FROM walk w JOIN graph_edges e ON e.src = w.b WHERE w.d < 12), pairs AS (SELECT DISTINCT a, b FROM walk), mutual AS (SELECT x.a AS path, min(x.b) AS component FROM pairs x JOIN pairs y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query()
def scc(spark, sf_dir):
    return graph.scc(fact(spark, sf_dir, "modules"), fact(spark, sf_dir, "graph_edges"))


ORACLES["scc"] = _recursive(f"{_closure} SELECT path, component FROM mutual", "modules", "graph_edges")


@query()
def cycles(spark, sf_dir):
    edges = fact(spark, sf_dir, "graph_edges")
    return graph.cycles(graph.scc(fact(spark, sf_dir, "modules"), edges), edges).select("component", text("members").alias("members"), "n")


ORACLES["cycles"] = _recursive(
    f"{_closure} SELECT component, string_agg(path, ',' ORDER BY path) AS members, count(*) AS n FROM mutual GROUP BY component HAVING count(*) > 1 OR component IN (SELECT src FROM graph_edges WHERE src = dst)", "modules", "graph_edges"
)

_package = lambda c: "CASE " + " ".join(f"WHEN {c} = '{r}' OR starts_with({c}, '{r}/') THEN '{i}'" for i, r in sorted(ROOTS.items(), key=lambda x: -len(x[1]))) + " END"


@query(f"SELECT * FROM (SELECT src, dst, {_package('src')} AS src_package, {_package('dst')} AS dst_package FROM graph_edges) WHERE src_package IS DISTINCT FROM dst_package", "graph_edges")
def boundary_crossings(spark, sf_dir):
    return graph.boundary_crossings(fact(spark, sf_dir, "graph_edges"), {i: r for i, r in ROOTS.items()})


def _blast(spark, sf_dir, **limits) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = fact(spark, sf_dir, "modules").select("path"), fact(spark, sf_dir, "graph_edges")
    return graph.blast_radius(nodes, edges, fact(spark, sf_dir, "changed_files").select("change_id", "path"), **limits)


@query()
def blast_radius(spark, sf_dir):
    return _blast(spark, sf_dir, max_depth=3, max_nodes=250)[0]


ORACLES["blast_radius"] = _recursive(
    f"""{METRICS}, walk(change_id, path, distance) AS (SELECT DISTINCT change_id, path, 0 FROM changed_files UNION SELECT w.change_id, e.src, w.distance + 1 FROM walk w JOIN graph_edges e ON e.dst = w.path WHERE w.distance < 3)
    SELECT change_id, path, min(distance) AS distance, any_value(fan_in) AS fan_in, any_value(fan_out) AS fan_out FROM walk JOIN metrics USING (path) GROUP BY change_id, path""",
    "modules",
    "graph_edges",
    "changed_files",
)


EXPORTS = """sides AS (SELECT coalesce(b.change_id, h.change_id) AS change_id, coalesce(b.path, h.path) AS path, coalesce(b.name, h.name) AS name,
  CASE WHEN b.name IS NULL THEN 'added' WHEN h.name IS NULL THEN 'removed' WHEN b.signature <> h.signature THEN 'modified' END AS change
  FROM (SELECT * FROM exports WHERE side = 'base') b FULL OUTER JOIN (SELECT * FROM exports WHERE side = 'head') h ON b.change_id = h.change_id AND b.path = h.path AND b.name = h.name),
  export_changes AS (SELECT * FROM sides WHERE change IS NOT NULL)"""


@query(f"WITH {EXPORTS} SELECT change_id, path, name, change FROM export_changes", "exports")
def export_diff(spark, sf_dir):
    return relations.export_changes(fact(spark, sf_dir, "exports"))


R10 = "SELECT change_id, 'public-export:1:finding' AS finding_id, CASE WHEN bool_or(change <> 'added') THEN 'high' ELSE 'medium' END AS severity, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM export_changes GROUP BY change_id"
_register_rule("public_export", "public-export", f"WITH {EXPORTS} {R10}", "exports")

_all = {"dependency-manifest": (R1, 15), "high-fan-in": (R2, 25), "insufficient-coverage": (R4, 20), "infrastructure": (R3, 25), "large-change": (R5, 20), "migration": (R6, 25), "missing-owner": (R7, 15), "missing-related-tests": (R8, 20), "multi-area-change": (R9, 15), "public-export": (R10, 25), "sensitive-path": (R11, 25), "tests-added": (R12, -10)}
SCORED = f"""{REACH}, {FILES}, {OWNED}, {ELIGIBLE}, {CHANGED}, {CONCERNS}, {TESTS}, {SOURCES}, {EXPORTS},
  findings AS ({' UNION ALL '.join(f"SELECT change_id, '{i}' AS rule_id, CAST({w} AS DOUBLE) AS weight, finding_id FROM ({s})" for i, (s, w) in _all.items())}),
  raw AS (SELECT change_id, rule_id, sum(weight) AS raw, string_agg(finding_id, ',' ORDER BY finding_id) AS finding_ids FROM findings GROUP BY change_id, rule_id),
  contributions AS (SELECT change_id, rule_id, raw, finding_ids, CASE WHEN raw < 0 THEN greatest(raw, -greatest(p + coalesce(before, 0), 0)) ELSE raw END + 0.0 AS weight
    FROM (SELECT *, sum(greatest(raw, 0)) OVER (PARTITION BY change_id) AS p, sum(least(raw, 0)) OVER (PARTITION BY change_id ORDER BY rule_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM raw)),
  scores AS (SELECT c.change_id, coalesce(sum(weight), 0) + 0.0 AS score FROM (SELECT DISTINCT change_id FROM changes) c LEFT JOIN contributions USING (change_id) GROUP BY c.change_id),
  classed AS (SELECT *, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'moderate' ELSE 'low' END AS classification FROM scores)"""
_scored = ("modules", "graph_edges", "changed_files", "coverage_records", "coverage_baseline", "changed_ranges", "exports", "changes")


def _findings(spark, sf_dir) -> DataFrame:
    return rules.evaluate(facts(spark, sf_dir, shared=True), settings=SETTINGS)


@query()
def findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("change_id", "rule_id", "finding_id", "weight")


@query()
def contributions(spark, sf_dir):
    return scoring.contributions(_findings(spark, sf_dir)).select("change_id", "rule_id", "raw", "weight", text("finding_ids").alias("finding_ids"))


def _scores(spark, sf_dir) -> DataFrame:
    return scoring.scores(fact(spark, sf_dir, "changes"), scoring.contributions(_findings(spark, sf_dir)))


@query()
def risk_score(spark, sf_dir):
    return _scores(spark, sf_dir)


@query()
def risk_classification(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"))


@query()
def gate(spark, sf_dir):
    return _scores(spark, sf_dir).select("change_id", stats.gate(F.col("classification"), "high").alias("exit_code"))


ORACLES["findings"] = _recursive(f"{SCORED} SELECT change_id, rule_id, finding_id, weight FROM findings", *_scored)
ORACLES["contributions"] = _recursive(f"{SCORED} SELECT change_id, rule_id, raw, weight, finding_ids FROM contributions", *_scored)
ORACLES["risk_score"] = _recursive(f"{SCORED} SELECT change_id, score, classification FROM classed", *_scored)
ORACLES["risk_classification"] = _recursive(f"{SCORED} SELECT classification, count(*) AS n FROM classed GROUP BY classification", *_scored)
ORACLES["gate"] = _recursive(f"{SCORED} SELECT change_id, CASE WHEN classification IN ('high', 'critical') THEN 2 ELSE 0 END AS exit_code FROM classed", *_scored)


SEG = ", ".join(evaluation.SEGMENT)
SIZE = "CASE WHEN files <= 5 AND lines <= 100 THEN 'small' WHEN files <= 20 AND lines <= 500 THEN 'medium' ELSE 'large' END"
SEGMENTS = f"""joined AS (SELECT c.*, left_tier, right_tier, resolved, insufficient, CASE classification WHEN 'low' THEN 0 WHEN 'moderate' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 END AS actual FROM cases c JOIN labels_r USING (case_id)),
  seg AS (SELECT *, 'cohort' AS scope, 'all' AS value FROM joined UNION ALL SELECT *, 'language', language FROM joined UNION ALL SELECT *, 'change-size', {SIZE} FROM joined WHERE status = 'complete'),
  done AS (SELECT * FROM seg WHERE status = 'complete' AND resolved IS NOT NULL)"""
_eval = ("cases", "labels_r")


def six(c):
    return stats.half_up(c if not isinstance(c, str) else F.col(c), 6)


SIX = lambda x: f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


def _segmented(spark, sf_dir) -> DataFrame:
    made: dict[str, DataFrame] = {}
    return evaluation.segmented(fact(spark, sf_dir, "cases", made), fact(spark, sf_dir, "labels_r", made))


@query(f"WITH {SEGMENTS} SELECT {SEG}, count(*) AS cases, count(*) FILTER (status = 'complete') AS analyzable, count(*) FILTER (insufficient) AS insufficient, count(*) FILTER (status = 'complete' AND resolved IS NOT NULL) AS evaluated, CASE WHEN count(*) FILTER (status = 'complete' AND resolved IS NOT NULL) >= 40 THEN 'sufficient' ELSE 'insufficient' END AS comparison FROM seg GROUP BY {SEG}", *_eval)
def segments(spark, sf_dir):
    return evaluation.rates(_segmented(spark, sf_dir))


_wilson = """SELECT {seg}, n, k, rate, {lower} AS lower, {upper} AS upper FROM (SELECT *, k / CAST(n AS DOUBLE) AS rate FROM (SELECT {seg}, count(*) AS n, count(*) FILTER (status = 'complete') AS k FROM seg GROUP BY {seg}))"""
_bound = lambda sign: f"greatest(0, least(1, (rate + {stats.Z} * {stats.Z} / (2 * n) {sign} {stats.Z} * sqrt(rate * (1 - rate) / n + {stats.Z} * {stats.Z} / (4 * n * CAST(n AS DOUBLE)))) / (1 + {stats.Z} * {stats.Z} / n)))"


@query(f"WITH {SEGMENTS} SELECT {SEG}, n, k, {SIX('rate')} AS rate, {SIX('lower')} AS lower, {SIX('upper')} AS upper FROM ({_wilson.format(seg=SEG, lower=_bound('-'), upper=_bound('+'))})", *_eval)
def wilson(spark, sf_dir):
    out = evaluation.rates(_segmented(spark, sf_dir)).select(*evaluation.SEGMENT, F.col("cases").alias("n"), F.col("analyzable").alias("k"), stats.wilson(F.col("analyzable"), F.col("cases")).alias("w"))
    return out.select(*evaluation.SEGMENT, "n", "k", *[six(F.col(f"w.{c}")).alias(c) for c in ("rate", "lower", "upper")])


MATRIX = f"""tiers AS (SELECT unnest([0, 1, 2, 3]) AS t), matrix AS (SELECT {', '.join(f's.{c}' for c in evaluation.SEGMENT)}, r.t AS resolved, a.t AS actual, count(d.case_id) AS n FROM (SELECT DISTINCT {SEG} FROM seg) s CROSS JOIN tiers r CROSS JOIN tiers a
  LEFT JOIN done d ON {' AND '.join(f'd.{c} = s.{c}' for c in evaluation.SEGMENT)} AND d.resolved = r.t AND d.actual = a.t GROUP BY ALL)"""


@query(f"WITH {SEGMENTS}, {MATRIX} SELECT {SEG}, resolved, actual, n FROM matrix", *_eval)
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_segmented(spark, sf_dir))


@query(f"WITH {SEGMENTS} SELECT {SEG}, count(*) AS n, count(*) FILTER (actual = resolved) AS exact, count(*) FILTER (abs(actual - resolved) <= 1) AS within_one, count(*) FILTER (actual - resolved = -1) AS under_one, count(*) FILTER (actual - resolved <= -2) AS under_two, count(*) FILTER (actual - resolved = 1) AS over_one, count(*) FILTER (actual - resolved >= 2) AS over_two FROM done GROUP BY {SEG}", *_eval)
def triage(spark, sf_dir):
    return evaluation.triage(_segmented(spark, sf_dir))


TIERED = f"""tiered AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / predicted END AS p, CASE WHEN support = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / support END AS r FROM (
  SELECT {SEG}, t, CAST(sum(n) FILTER (resolved = t) AS BIGINT) AS support, CAST(sum(n) FILTER (resolved = t AND actual = t) AS BIGINT) AS hit, CAST(sum(n) FILTER (actual = t) AS BIGINT) AS predicted FROM matrix, tiers GROUP BY {SEG}, t)))"""
_names = "CASE t " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(stats.TIERS)) + " END"


@query(f"WITH {SEGMENTS}, {MATRIX}, {TIERED} SELECT {SEG}, {_names} AS tier, support, hit, predicted, {SIX('p')} AS precision, {SIX('r')} AS recall, {SIX('f1')} AS f1 FROM tiered", *_eval)
def tier_metrics(spark, sf_dir):
    out = evaluation.tier_metrics(evaluation.confusion(_segmented(spark, sf_dir)))
    return out.select(*evaluation.SEGMENT, "tier", "support", "hit", "predicted", *[six(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SEGMENTS}, {MATRIX}, {TIERED} SELECT {SEG}, {SIX('macro')} AS macro_f1, {SIX('CASE WHEN support = 0 THEN 0.0 ELSE CAST(hit AS DOUBLE) / support END')} AS high_recall FROM (SELECT {SEG}, sum(f1) / 4 AS macro FROM tiered GROUP BY {SEG}) JOIN (SELECT {SEG}, sum(n) FILTER (resolved >= 2) AS support, sum(n) FILTER (resolved >= 2 AND actual >= 2) AS hit FROM matrix GROUP BY {SEG}) USING ({SEG})", *_eval)
def macro_f1(spark, sf_dir):
    out = evaluation.macro_f1(evaluation.confusion(_segmented(spark, sf_dir)))
    return out.select(*evaluation.SEGMENT, six("macro_f1").alias("macro_f1"), six("high_recall").alias("high_recall"))


_moments = lambda x, y: f"CASE WHEN abs(e) > 1e-12 THEN greatest(-1, least(1, 1 - o / e)) END AS k FROM (SELECT {SEG}, avg(CAST(({x} - {y}) * ({x} - {y}) AS DOUBLE)) AS o, avg(CAST({x} * {x} AS DOUBLE)) + avg(CAST({y} * {y} AS DOUBLE)) - 2 * avg(CAST({x} AS DOUBLE)) * avg(CAST({y} AS DOUBLE)) AS e"


@query(f"WITH {SEGMENTS} SELECT {SEG}, {SIX('k')} AS kappa FROM (SELECT {SEG}, {_moments('resolved', 'actual')} FROM done GROUP BY {SEG}))", *_eval)
def kappa(spark, sf_dir):
    return evaluation.kappa(_segmented(spark, sf_dir)).select(*evaluation.SEGMENT, six("kappa").alias("kappa"))


@query(f"WITH {SEGMENTS} SELECT {SEG}, pairs, exact, within_one, {SIX('CASE WHEN abs(e) > 1e-12 THEN greatest(-1, least(1, 1 - o / e)) END')} AS kappa FROM (SELECT {SEG}, count(*) AS pairs, count(*) FILTER (left_tier = right_tier) AS exact, count(*) FILTER (abs(left_tier - right_tier) <= 1) AS within_one, avg(CAST((left_tier - right_tier) * (left_tier - right_tier) AS DOUBLE)) AS o, avg(CAST(left_tier * left_tier AS DOUBLE)) + avg(CAST(right_tier * right_tier AS DOUBLE)) - 2 * avg(CAST(left_tier AS DOUBLE)) * avg(CAST(right_tier AS DOUBLE)) AS e FROM seg WHERE NOT insufficient GROUP BY {SEG})", *_eval)
def reviewer_agreement(spark, sf_dir):
    return evaluation.agreement(_segmented(spark, sf_dir)).select(*evaluation.SEGMENT, "pairs", "exact", "within_one", six("kappa").alias("kappa"))


@query(f"""WITH {SEGMENTS}, ranked AS (SELECT {SEG}, rank() OVER (PARTITION BY {SEG} ORDER BY score) + (count(*) OVER (PARTITION BY {SEG}, score) - 1) / 2.0 AS x, rank() OVER (PARTITION BY {SEG} ORDER BY resolved) + (count(*) OVER (PARTITION BY {SEG}, resolved) - 1) / 2.0 AS y FROM done)
  SELECT {SEG}, {SIX('s')} AS spearman FROM (SELECT {SEG}, CASE WHEN count(*) >= 2 AND var_pop(x) * var_pop(y) > 1e-12 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS s FROM ranked GROUP BY {SEG})""", *_eval)
def spearman(spark, sf_dir):
    return evaluation.spearman(_segmented(spark, sf_dir)).select(*evaluation.SEGMENT, six("spearman").alias("spearman"))


_dense = lambda names, column: f"SELECT s.*, v.{column} FROM (SELECT DISTINCT {SEG} FROM seg) s CROSS JOIN (SELECT unnest([{', '.join(repr(n) for n in names)}]) AS {column}) v"


@query(f"WITH {SEGMENTS}, dense AS ({_dense(stats.UNAVAILABLE_REASONS, 'reason')}), counted AS (SELECT {SEG}, reason, count(*) AS k FROM seg WHERE status = 'unavailable' GROUP BY ALL) SELECT {SEG}, reason, coalesce(k, 0) AS n FROM dense LEFT JOIN counted USING ({SEG}, reason)", *_eval)
def unavailable_prevalence(spark, sf_dir):
    return evaluation.unavailable(_segmented(spark, sf_dir))


_category = "CASE " + " ".join(f"WHEN starts_with(lower(trim(limitation)), '{p}') THEN '{c}'" for p, c in stats.LIMITATIONS) + " ELSE 'other' END"


@query(f"WITH {SEGMENTS}, dense AS ({_dense(stats.LIMITATION_CATEGORIES, 'category')}), kinds AS (SELECT DISTINCT case_id, {_category} AS category FROM case_limitations), counted AS (SELECT {SEG}, category, count(*) AS k FROM seg JOIN kinds USING (case_id) WHERE status = 'complete' GROUP BY ALL) SELECT {SEG}, category, coalesce(k, 0) AS n FROM dense LEFT JOIN counted USING ({SEG}, category)", *_eval, "case_limitations")
def limitation_prevalence(spark, sf_dir):
    return evaluation.limitation_prevalence(_segmented(spark, sf_dir), fact(spark, sf_dir, "case_limitations"))


@query(f"WITH {SEGMENTS} SELECT {SEG}, rule_id, count(DISTINCT case_id) AS cases, count(*) AS findings FROM seg JOIN case_findings USING (case_id) WHERE status = 'complete' GROUP BY ALL", *_eval, "case_findings")
def finding_prevalence(spark, sf_dir):
    return evaluation.finding_prevalence(_segmented(spark, sf_dir), fact(spark, sf_dir, "case_findings"))


@query(f"WITH {SEGMENTS}, r AS (SELECT DISTINCT case_id, rule_id FROM case_findings), p AS (SELECT a.case_id, a.rule_id AS left_rule, b.rule_id AS right_rule FROM r a JOIN r b ON a.case_id = b.case_id AND a.rule_id < b.rule_id) SELECT {SEG}, left_rule, right_rule, count(*) AS cases FROM seg JOIN p USING (case_id) WHERE status = 'complete' GROUP BY ALL", *_eval, "case_findings")
def rule_cooccurrence(spark, sf_dir):
    return evaluation.cooccurrence(_segmented(spark, sf_dir), fact(spark, sf_dir, "case_findings"))


@query("""WITH repos AS (SELECT repository_id, count(DISTINCT split) AS splits, bool_or(split = 'unseen-repository') AS unseen, max(sequence_no) FILTER (split = 'development') AS d, min(sequence_no) FILTER (split = 'forward-time') AS f FROM cases GROUP BY repository_id)
  SELECT 'duplicate-group-crosses' AS "check", CAST(duplicate_group AS VARCHAR) AS key FROM cases GROUP BY duplicate_group HAVING count(DISTINCT repository_id) > 1 OR count(DISTINCT split) > 1
  UNION ALL SELECT 'unseen-repository-seen', CAST(repository_id AS VARCHAR) FROM repos WHERE unseen AND splits > 1
  UNION ALL SELECT 'forward-before-development', CAST(repository_id AS VARCHAR) FROM repos WHERE f <= d
  UNION ALL SELECT 'duplicate-case', CAST(case_id AS VARCHAR) FROM cases GROUP BY case_id HAVING count(*) > 1
  UNION ALL SELECT 'too-many-cases', CAST(count(*) AS VARCHAR) FROM cases HAVING count(*) > 10000
  UNION ALL SELECT 'duplicate-sequence', concat(repository_id, '/', sequence_no) FROM cases GROUP BY repository_id, sequence_no HAVING count(*) > 1
  UNION ALL SELECT 'case-without-label', CAST(case_id AS VARCHAR) FROM cases WHERE case_id NOT IN (SELECT case_id FROM labels_r)""", *_eval)
def corpus_checks(spark, sf_dir):
    made: dict[str, DataFrame] = {}
    return checks.corpus(fact(spark, sf_dir, "cases", made), fact(spark, sf_dir, "labels_r", made))


@query(f"WITH {FILES}, {ELIGIBLE}, given AS (SELECT DISTINCT change_id, path FROM eligible JOIN coverage_records USING (path)) SELECT 'missing' AS \"check\", path AS key FROM (SELECT DISTINCT change_id, path FROM eligible EXCEPT SELECT * FROM given)", "changed_files", "coverage_records")
def coverage_completeness(spark, sf_dir):
    want = coverage.eligible(files(spark, sf_dir)).select("change_id", "path")
    return checks.completeness(want, want.join(fact(spark, sf_dir, "coverage_records").select("path"), "path", "left_semi"))
