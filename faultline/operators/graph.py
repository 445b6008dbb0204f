"""Dependency-graph operators over edge tables.

Edges point from importer (src) to dependency (dst). All loops work on whole
frontiers, several seeds or changes at once, and cut their lineage per level.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import valid_module_path
from ..plans.cut import cut, is_empty
from .ownership import ignore


def construct(nodes: DataFrame, edges: DataFrame, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """G1: distinct edges; invalid paths, unknown endpoints, duplicate nodes and graphs beyond their limits are errors."""
    for rows, most, what in ((nodes, max_nodes, "node"), (edges, max_edges, "edge")):
        if most is not None and rows.limit(most + 1).count() > most:
            raise ValueError(f"graph {what} limit exceeded")
    if not is_empty(nodes.where(~F.coalesce(valid_module_path(F.col("path")), F.lit(False)))):
        raise ValueError("graph nodes must be valid paths")
    if not is_empty(nodes.groupBy("path").count().where("count > 1")):
        raise ValueError("graph nodes must be unique")
    ends = edges.select(F.col("src").alias("path")).union(edges.select("dst"))
    if not is_empty(ends.join(nodes, "path", "left_anti")):
        raise ValueError("graph edges must connect known nodes")
    return edges.dropDuplicates(["src", "dst"])


def listed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph's nodes and edges in path order."""
    return nodes.select("path").orderBy("path"), edges.select("src", "dst").orderBy("src", "dst")


def from_imports(imports: DataFrame) -> DataFrame:
    """An edge per internal import with a target."""
    return imports.where("resolution = 'internal' AND target_path IS NOT NULL").select(F.col("path").alias("src"), F.col("target_path").alias("dst")).distinct()


def included(modules: DataFrame, references: DataFrame, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """P5: modules that no pattern matches, and their references less the internal ones whose target went."""
    kept = ignore(modules, patterns) if patterns else modules
    names = kept.select("path").distinct()
    own = references.join(names, "path", "left_semi")
    known = names.select(F.col("path").alias("known"))
    lost = own.where("resolution = 'internal'").select("target_path").distinct().join(known, F.col("target_path") == F.col("known"), "left_anti").select(F.col("target_path").alias("lost"))
    return kept, own.join(lost, (F.col("resolution") == "internal") & F.col("target_path").eqNullSafe(F.col("lost")), "left_anti")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fan_in and fan_out of every node. One aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("path").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return nodes.select("path").join(counts, "path", "left").select("path", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def direct_dependents(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seed, dependent."""
    return edges.join(seeds.select(F.col("path").alias("dst")).distinct(), "dst").select(F.col("dst").alias("seed"), F.col("src").alias("dependent"))


def transitive_dependents(edges: DataFrame, seeds: DataFrame, max_depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """(seed, dependent, distance) and the seeds that were truncated.

    Every seed's search runs in one frame. A level joins the frontier with the
    edges and drops what the seed has already seen.
    """
    if not 1 <= max_depth <= 100:
        raise ValueError("depth must be 1 to 100")
    reverse = cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")))
    seen = cut(seeds.select(F.col("path").alias("seed"), F.col("path").alias("node"), F.lit(0).alias("distance")).distinct())
    frontier = seen

    def step(frontier: DataFrame, seen: DataFrame, distance: int) -> DataFrame:
        reached = frontier.select("seed", "node").join(reverse, "node").select("seed", F.col("next").alias("node")).distinct()
        return reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("distance", F.lit(distance))

    for distance in range(1, max_depth + 1):
        frontier = cut(step(frontier, seen, distance))
        if is_empty(frontier):
            break
        seen = seen.unionByName(frontier)  # of frames that are written already
    truncated = step(frontier, seen, 0).select("seed").distinct()
    return seen.where("distance > 0").select("seed", F.col("node").alias("dependent"), "distance"), truncated


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The largest label that reaches each node along the edges, to a fixpoint."""
    while True:
        sent = edges.join(labels, F.col("src") == F.col("path")).select(F.col("dst").alias("path"), "label")
        new = cut(labels.unionByName(sent).groupBy("path").agg(F.max("label").alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "was"), "path").where("label <> was")
        done = is_empty(moved)
        labels = new
        if done:
            return labels


def weak_components(edges: DataFrame) -> DataFrame:
    """path and weak: a name for each set of nodes that edges connect either way, smallest member first.

    Alternating large-star and small-star steps: the rounds grow with the
    logarithm of the longest chain, not with its length.
    """
    pairs = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        moved = not is_empty(new.join(pairs, ["u", "v"], "left_anti")) or not is_empty(pairs.join(new, ["u", "v"], "left_anti"))
        pairs = new
        if not moved:
            break
    stars = pairs.groupBy("u").agg(F.min("v").alias("weak")).select(F.col("u").alias("path"), "weak")
    return stars.unionByName(pairs.select(F.col("v").alias("path"), F.col("v").alias("weak")).distinct())


#: Edges of a weak component that one task searches.
EDGES_AT_ONCE = 2_000_000


def _strong(sources: list[str], targets: list[str]) -> dict[str, str]:
    """Component of each node, named by its smallest member: two depth-first passes without recursion."""
    ahead: dict[str, list[str]] = {}
    back: dict[str, list[str]] = {}
    for s, t in zip(sources, targets, strict=True):
        ahead.setdefault(s, []).append(t)
        back.setdefault(t, []).append(s)
    order, seen = [], set()
    for start in ahead.keys() | back.keys():
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(ahead.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            for following in rest:
                if following not in seen:
                    seen.add(following)
                    stack.append((following, iter(ahead.get(following, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
    out: dict[str, str] = {}
    done: set[str] = set()
    for start in reversed(order):
        if start in done:
            continue
        done.add(start)
        members, at = [start], 0
        while at < len(members):
            for before in back.get(members[at], ()):
                if before not in done:
                    done.add(before)
                    members.append(before)
            at += 1
        name = min(members)
        out |= dict.fromkeys(members, name)
    return out


def scc(nodes: DataFrame, edges: DataFrame, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Path and component, named by its smallest member.

    A graph of at most ``at_once`` edges is searched in one task, else each of its
    weak components of that size in a task of its own; only larger ones are
    coloured by frontier steps over the cluster.
    """
    all_nodes, real = nodes.select("path").distinct(), cut(edges.where("src <> dst").select("src", "dst").distinct())

    def search(table: pa.Table) -> pa.Table:
        found = _strong(table["src"].to_pylist(), table["dst"].to_pylist())
        return pa.table({"path": pa.array(list(found), pa.string()), "component": pa.array(list(found.values()), pa.string())})

    if real.count() <= at_once:
        found = cut(real.withColumn("weak", F.lit(0)).groupBy("weak").applyInArrow(search, "path string, component string"))
    else:
        weak = cut(weak_components(real))
        named = cut(real.join(weak, F.col("src") == F.col("path")).drop("path"))
        large = cut(named.groupBy("weak").agg(F.count("*").alias("n")).where(F.col("n") > at_once).select("weak"))
        found = named.join(large, "weak", "left_anti").groupBy("weak").applyInArrow(search, "path string, component string")
        if not is_empty(large):
            rest = cut(named.join(large, "weak", "left_semi").drop("weak"))
            found = found.unionByName(coloured(rest.select(F.explode(F.array("src", "dst")).alias("path")).distinct(), rest))
        found = cut(found)
    return all_nodes.join(found, "path", "left").select("path", F.coalesce("component", "path").alias("component"))


def coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components by colouring, for graphs beyond one task.

    Nodes without a predecessor or successor among the rest are components of
    their own and go first. Then every node gets the largest name that reaches it
    (its colour); the nodes that reach their colour's owner back within the
    colour are that owner's component. The rest repeats.
    """
    left, rest = cut(nodes.select("path").distinct()), cut(edges.where("src <> dst").distinct())
    done = []
    while not is_empty(left):
        while True:
            inner = rest.select(F.col("src").alias("path")).distinct().join(rest.select(F.col("dst").alias("path")).distinct(), "path")
            single = cut(left.join(inner, "path", "left_anti"))
            if is_empty(single):
                break
            done.append(single.select("path", F.col("path").alias("root")))
            left = cut(left.join(single, "path", "left_anti"))
            keep = left.select(F.col("path").alias("k"))
            rest = cut(rest.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi"))
        if is_empty(left):
            break
        colour = _spread(rest, left.select("path", F.col("path").alias("label")))
        named = colour.select(F.col("path").alias("n"), F.col("label").alias("c"))
        same = rest.join(named, F.col("src") == F.col("n")).select("src", "dst", F.col("c").alias("cs")).join(named, F.col("dst") == F.col("n")).where("c = cs").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        back = _spread(cut(same), colour.select("path", F.when(F.col("path") == F.col("label"), F.col("path")).alias("label")).select("path", F.coalesce("label", F.lit("")).alias("label")))
        found = cut(back.join(named, F.col("path") == F.col("n")).where("label = c").select("path", F.col("c").alias("root")))
        done.append(found)
        left = cut(left.join(found, "path", "left_anti"))
        keep = left.select(F.col("path").alias("k"))
        rest = cut(rest.join(keep, F.col("src") == F.col("k"), "left_semi").join(keep, F.col("dst") == F.col("k"), "left_semi"))
    if not done:
        return nodes.select("path", F.col("path").alias("component"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    names = out.groupBy("root").agg(F.min("path").alias("component"))
    return out.join(names, "root").select("path", "component")


def cycles(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with several members or a self-loop."""
    sizes = components.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("members"))
    loops = edges.where("src = dst").select(F.col("src").alias("component")).distinct().withColumn("loop", F.lit(True))
    return sizes.join(loops, "component", "left").where("n > 1 OR loop").select("component", "members", "n")


def package_of(path, roots: dict[str, str]):
    """The package with the longest root that holds the path, null if none does."""
    out = None
    for root, name in sorted(((r, i) for i, r in roots.items()), key=lambda x: (-len(x[0]), x[0])):
        inside = F.lit(True) if root == "" else (path == root) | path.startswith(root + "/")
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return F.lit(None).cast("string") if out is None else out


def boundary_crossings(edges: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Edges between different packages (no package counts as one)."""
    owned = edges.select("src", "dst", package_of(F.col("src"), roots).alias("src_package"), package_of(F.col("dst"), roots).alias("dst_package"))
    return owned.where(~F.col("src_package").eqNullSafe(F.col("dst_package")))


def blast_radius(nodes: DataFrame, edges: DataFrame, changed: DataFrame, max_depth: int = 20, max_nodes: int = 120, max_edges: int = 500, max_unindexed: int = 250) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and totals of each change's budgeted neighbourhood.

    Nodes: change_id, path, distance, fan_in, fan_out. Edges: change_id, src,
    dst. Totals: change_id, changed, unindexed (array), node and edge counts of
    the graph, truncated. Budgets apply per change by row_number in path order.
    """
    for value, most in ((max_depth, 100), (max_nodes, 250), (max_edges, 1_000)):
        if not 1 <= value <= most:
            raise ValueError("blast-radius limits are out of range")
    edges = cut(edges.dropDuplicates(["src", "dst"]))
    reverse = edges.select(F.col("dst").alias("path"), F.col("src").alias("next"))
    unique = cut(changed.select("change_id", "path").distinct().join(nodes.select("path", F.lit(True).alias("indexed")).distinct(), "path", "left"))
    by_path = Window.partitionBy("change_id").orderBy("path")
    indexed = unique.where("indexed").select("change_id", "path").withColumn("rank", F.row_number().over(by_path))
    missing = unique.where("indexed IS NULL").select("change_id", "path").withColumn("rank", F.row_number().over(by_path))
    flags = [indexed.where(F.col("rank") > max_nodes).select("change_id"), missing.where(F.col("rank") > max_unindexed).select("change_id")]
    seen = cut(indexed.where(F.col("rank") <= max_nodes).select("change_id", "path", F.lit(0).alias("distance")))
    frontier = seen
    for distance in range(1, max_depth + 1):
        reach = frontier.select("change_id", "path").join(reverse, "path").select("change_id", F.col("next").alias("path")).distinct().join(seen.select("change_id", "path"), ["change_id", "path"], "left_anti")
        size = seen.groupBy("change_id").agg(F.count("*").alias("have"))
        ranked = cut(reach.withColumn("rank", F.row_number().over(by_path)).join(size, "change_id").select("change_id", "path", "rank", "have"))
        if is_empty(ranked):
            break
        flags.append(ranked.where(F.col("rank") + F.col("have") > max_nodes).select("change_id"))
        frontier = cut(ranked.where(F.col("rank") + F.col("have") <= max_nodes).select("change_id", "path", F.lit(distance).alias("distance")))
        seen = seen.unionByName(frontier)
        if distance == max_depth:
            flags.append(frontier.join(reverse, "path").select("change_id", F.col("next").alias("path")).join(seen.select("change_id", "path"), ["change_id", "path"], "left_anti").select("change_id"))
    inside = seen.select("change_id", F.col("path").alias("src")).join(edges, "src").join(seen.select("change_id", F.col("path").alias("dst")), ["change_id", "dst"]).select("change_id", "src", "dst")
    numbered = cut(inside.withColumn("rank", F.row_number().over(Window.partitionBy("change_id").orderBy("src", "dst"))))
    flags.append(numbered.where(F.col("rank") > max_edges).select("change_id"))
    cuts = flags[0]
    for f in flags[1:]:
        cuts = cuts.union(f)
    out_nodes = seen.join(metrics(nodes, edges), "path").select("change_id", "path", "distance", "fan_in", "fan_out")
    totals = unique.groupBy("change_id").agg(F.count("*").alias("changed")).join(missing.where(F.col("rank") <= max_unindexed).groupBy("change_id").agg(F.array_sort(F.collect_list("path")).alias("unindexed")), "change_id", "left")
    totals = totals.join(cuts.distinct().withColumn("cut", F.lit(True)), "change_id", "left")
    n_nodes, n_edges = nodes.select("path").distinct().count(), edges.count()
    totals = totals.select("change_id", "changed", F.coalesce("unindexed", F.array().cast("array<string>")).alias("unindexed"), F.lit(n_nodes).alias("graph_nodes"), F.lit(n_edges).alias("graph_edges"), F.coalesce("cut", F.lit(False)).alias("truncated"))
    return out_nodes, numbered.where(F.col("rank") <= max_edges).drop("rank"), totals
