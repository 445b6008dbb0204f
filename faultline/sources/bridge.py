"""Change facts derived from the star-schema tables.

Every fact is one SQL text in the common dialect of Spark and DuckDB, with the
tables it reads in braces. ``fact`` builds it in Spark; ``with_clause`` gives the
same definitions as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FACTS: dict[str, str] = {
    "modules": """
        SELECT p_partkey AS part_key, p_brand AS brand, CAST(p_size AS BIGINT) AS size,
          concat(CASE g % 6 WHEN 0 THEN 'src/auth' WHEN 1 THEN 'src/core' WHEN 2 THEN 'packages/api/src' WHEN 3 THEN 'terraform' WHEN 4 THEN 'migrations' ELSE 'docs' END, '/',
            CASE k WHEN 0 THEN concat('m', CAST(g AS STRING), '.ts') WHEN 1 THEN concat('m', CAST(g AS STRING), '.test.ts')
              WHEN 2 THEN concat('__tests__/n', CAST(g AS STRING), '.ts') WHEN 3 THEN concat('n', CAST(g AS STRING), '.ts')
              WHEN 4 THEN concat('p', CAST(g AS STRING), '/index.ts') WHEN 5 THEN concat('s', CAST(g AS STRING), '.py')
              WHEN 6 THEN concat('q', CAST(g AS STRING), '/package.json') ELSE concat('r', CAST(g AS STRING), '.generated.ts') END) AS path
        FROM (SELECT p_partkey, p_brand, p_size, CAST(floor(p_partkey / 8.0) AS BIGINT) AS g, p_partkey % 8 AS k FROM {part}) t""",
    "changed_files": """
        SELECT l_orderkey AS change_id, path,
          CASE WHEN max(l_returnflag) = 'R' THEN 'deleted' WHEN max(l_returnflag) = 'A' THEN 'added' WHEN min(l_linestatus) = 'F' THEN 'renamed' ELSE 'modified' END AS status,
          CAST(4 * sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions, CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS deletions
        FROM {lineitem} l JOIN {modules} m ON l.l_partkey = m.part_key GROUP BY l_orderkey, path""",
    "graph_edges": """
        SELECT DISTINCT ma.path AS src, mb.path AS dst FROM {lineitem} a
        JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        JOIN {modules} ma ON a.l_partkey = ma.part_key JOIN {modules} mb ON b.l_partkey = mb.part_key WHERE ma.brand = mb.brand""",
    "coverage_records": """
        SELECT path, CASE WHEN part_key % 17 = 0 THEN 0 ELSE 10 + size END AS lines_found,
          CASE WHEN part_key % 17 = 0 THEN 0 ELSE least(10 + size, CAST(floor((10 + size) * (part_key % 11) / 10.0) AS BIGINT)) END AS lines_hit
        FROM {modules} WHERE part_key % 13 <> 0""",
    "coverage_baseline": """
        SELECT path, 10 + size AS lines_found, least(10 + size, CAST(floor((10 + size) * (part_key % 7 + 4) / 10.0) AS BIGINT)) AS lines_hit
        FROM {modules} WHERE part_key % 7 <> 0""",
    "changed_ranges": """
        SELECT l_orderkey AS change_id, path, min(1 + l_suppkey % 20) AS start, CAST(max(l_linenumber) AS BIGINT) AS span
        FROM {lineitem} l JOIN {modules} m ON l.l_partkey = m.part_key GROUP BY l_orderkey, path""",
    "exports": """
        SELECT concat('e', CAST(part_key AS STRING)) AS name, part_key % 40 AS change_id, side, concat('packages/p', CAST(part_key % 9 AS STRING), '/index.ts') AS path,
          concat('sig', CAST(CASE WHEN side = 'head' AND part_key % 3 = 0 THEN size + 1 ELSE size END AS STRING)) AS signature
        FROM {modules}, (SELECT 'base' AS side UNION ALL SELECT 'head' AS side) s
        WHERE NOT (side = 'base' AND part_key % 5 = 0) AND NOT (side = 'head' AND part_key % 7 = 0)""",
    "changes": """
        SELECT o_orderkey AS change_id, o_custkey % 10 AS repository_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority, o_orderstatus AS order_status FROM {orders}""",
    "case_totals": """
        SELECT change_id, count(*) AS files, sum(additions + deletions) AS lines FROM {changed_files} GROUP BY change_id""",
    "cases": """
        SELECT c.change_id AS case_id, repository_id, CASE WHEN c.change_id % 2 = 0 THEN 'typescript' ELSE 'python' END AS language,
          CASE c.change_id % 3 WHEN 0 THEN 'development' WHEN 1 THEN 'forward-time' ELSE 'unseen-repository' END AS split,
          CASE WHEN c.change_id % 4 = 0 THEN 'signal-enriched' ELSE 'representative' END AS stratum,
          CASE WHEN c.change_id % 8 < 4 THEN 'standard' ELSE 'strict' END AS profile, concat('digest-', CAST(c.change_id % 16 % 3 AS STRING)) AS configuration_digest, CASE WHEN c.change_id % 16 < 8 THEN '' ELSE 'api,data' END AS packs, c.change_id AS sequence_no, c.change_id % 50 AS duplicate_group,
          CASE WHEN t.change_id IS NULL OR c.change_id % 11 = 0 THEN 'unavailable' ELSE 'complete' END AS status,
          CASE WHEN t.change_id IS NULL THEN 'revision-unavailable' WHEN c.change_id % 11 = 0 THEN CASE c.change_id % 3 WHEN 0 THEN 'resource-limit' WHEN 1 THEN 'invalid-result' ELSE 'operational-error' END END AS reason,
          CAST(t.lines % 101 AS BIGINT) AS score,
          CASE WHEN t.lines % 101 >= 80 THEN 'critical' WHEN t.lines % 101 >= 50 THEN 'high' WHEN t.lines % 101 >= 20 THEN 'moderate' ELSE 'low' END AS classification,
          CAST(t.files AS BIGINT) AS files, CAST(t.lines AS BIGINT) AS lines
        FROM {changes} c LEFT JOIN {case_totals} t ON c.change_id = t.change_id""",
    "case_findings": """
        SELECT change_id AS case_id, 'large-change' AS rule_id FROM {case_totals} WHERE lines > 500
        UNION ALL SELECT change_id, 'multi-area-change' FROM {case_totals} WHERE files > 3
        UNION ALL SELECT change_id, 'sensitive-path' FROM {changed_files} WHERE path LIKE 'src/auth/%'
        UNION ALL SELECT change_id, 'migration' FROM {changed_files} WHERE path LIKE 'migrations/%' GROUP BY change_id""",
    "case_limitations": """
        SELECT change_id AS case_id, 'Ownership analysis skipped' AS limitation FROM {case_totals} WHERE change_id % 3 = 0
        UNION ALL SELECT change_id, '  Language analysis failed' FROM {case_totals} WHERE change_id % 4 = 0
        UNION ALL SELECT change_id, 'language index truncated' FROM {case_totals} WHERE change_id % 8 = 0
        UNION ALL SELECT change_id, 'Something else' FROM {case_totals} WHERE change_id % 9 = 0""",
    "labels_r": """
        SELECT change_id AS case_id, CAST(l AS INT) AS left_tier, CAST(r AS INT) AS right_tier,
          CASE WHEN insufficient THEN NULL WHEN l = r THEN CAST(l AS INT) WHEN abs(l - r) = 1 THEN CAST(l AS INT) ELSE CAST(floor((l + r) / 2.0) AS INT) END AS resolved, insufficient
        FROM (SELECT change_id, least(3, 5 - priority) AS l, change_id * 7 % 4 AS r, change_id % 17 = 0 AS insufficient FROM {changes}) t""",
}


def _reads(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def fact(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A fact or a table as a DataFrame."""
    made = {} if made is None else made
    if name not in made:
        if name in FACTS:
            made[name] = spark.sql(FACTS[name], **{x: fact(spark, sf_dir, x, made) for x in _reads(FACTS[name])})
        else:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return made[name]


def with_clause(*names: str) -> str:
    """The facts and whatever they read, as common table expressions for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in FACTS and name not in order:
            for x in _reads(FACTS[name]):
                visit(x)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{x} AS ({FACTS[x].format(**{y: y for y in _reads(FACTS[x])})})" for x in order)
