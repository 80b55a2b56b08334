"""The obligation graph: edges (src, dst, edge_type, weight) and nodes (obligation_id) as DataFrames.

An edge goes from an obligation to a related one; an obligation's dependents are its successors. Iterative operators keep the
frontier and what was seen as tables in the shared scratch folder, so that neither lineage nor the driver grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import lexicon as L
from statuta.session import materialize


def edges_from_related(register: DataFrame, edge_type: str = "related") -> DataFrame:
    """An edge per related id, weight 1; one edge per (src, dst)."""
    rows = register.select(F.col("obligation_id").alias("src"), F.explode("related_obligations").alias("dst")).distinct()
    return rows.select("src", "dst", F.lit(edge_type).alias("edge_type"), F.lit(1.0).alias("weight"))


def nodes_of(register: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of the register and of all edge ends."""
    ends = edges.select(F.col("src").alias("obligation_id")).unionByName(edges.select(F.col("dst").alias("obligation_id")))
    return register.select("obligation_id").unionByName(ends).distinct()


def direct_dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of the successors of each root."""
    return edges.join(roots.select(F.col("root").alias("src")), "src").select(F.col("src").alias("root"), F.col("dst").alias("node")).distinct()


def direct_dependencies(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of the predecessors of each root."""
    return edges.join(roots.select(F.col("root").alias("dst")), "dst").select(F.col("dst").alias("root"), F.col("src").alias("node")).distinct()


def edges_out_of(step: DataFrame, level: DataFrame) -> DataFrame:
    """The edges out of the nodes of a level, written: where they are few, the level is joined to them without being moved."""
    return materialize(step.join(level.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), "near-edges")


def not_seen(level: DataFrame, seen: DataFrame, near: DataFrame) -> DataFrame:
    """Rows of a new level that are not among those seen, of which only the ones at the ends of its edges are looked at."""
    again = materialize(seen.select("root", "node").join(near.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select("root", "node"), "seen-again")
    return level.join(again, ["root", "node"], "left_anti")


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth): all that is reachable from each root, at its least depth; a root on a cycle reaches itself."""
    step = materialize(edges.select("src", "dst").distinct(), "edges")
    frontier = materialize(direct_dependents(step, roots).withColumn("depth", F.lit(1)), "frontier")
    seen, depth = frontier, 1
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        near = edges_out_of(step, frontier)
        nxt = frontier.join(near, frontier["node"] == near["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = materialize(not_seen(nxt, seen, near).withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def propagate(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, kind): direct and, without those, indirect dependents of each root."""
    return reachable(edges, roots).select("root", "node", F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("kind"), "depth")


def impact_totals(spread: DataFrame) -> DataFrame:
    """One row: distinct direct and indirect nodes and their sum; a node that is both counts twice."""
    n = lambda k: F.countDistinct(F.when(F.col("kind") == k, F.col("node")))
    return spread.agg(n("direct").alias("direct"), n("indirect").alias("indirect")).withColumn("total", F.col("direct") + F.col("indirect"))


def impact_ratio(spread: DataFrame, existing: int) -> DataFrame:
    """Affected over existing, at most 1; 1 where none exist."""
    ratio = F.least(F.col("total") / F.lit(max(existing, 1)), F.lit(1.0)) if existing else F.lit(1.0)
    return impact_totals(spread).withColumn("impact_ratio", ratio)


def upstream(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(root, node, hop): predecessors within ``depth`` hops, the nearest having hop 0; each node once, at its least hop."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, roots, depth).select("root", "node", (F.col("depth") - 1).alias("hop"))


def affected_workflows(spread: DataFrame, register: DataFrame, stems: tuple[str, ...] = L.WORKFLOW_STEMS) -> DataFrame:
    """Distinct keywords of affected obligations that hold a workflow stem."""
    words = register.join(spread.select(F.col("node").alias("obligation_id")).distinct(), "obligation_id").select(F.explode("keywords").alias("workflow"))
    return words.filter(F.lower("workflow").rlike("|".join(stems))).distinct()


def timeline(spread: DataFrame, register: DataFrame) -> DataFrame:
    """Affected obligations by deadline text: deadline, obligation_count, ids."""
    hit = register.join(spread.select(F.col("node").alias("obligation_id")).distinct(), "obligation_id").filter(F.coalesce("deadline", F.lit("")) != "")
    return hit.groupBy("deadline").agg(F.count(F.lit(1)).alias("obligation_count"), F.array_sort(F.collect_list("obligation_id")).alias("ids")).orderBy("deadline")


def timeline_blocks(spread: DataFrame, register: DataFrame, block_ids: int = 1000) -> DataFrame:
    """``timeline`` in two levels: deadline, block, blocks, obligation_count (of the block), ids (sorted), with about ``block_ids`` ids a block.

    A deadline has as many blocks as its count asks for, and an id's block is the MD5 of the id, so however many ids share a
    deadline, no group gathers more than a block. Counts are taken before anything is gathered.
    """
    hit = register.join(spread.select(F.col("node").alias("obligation_id")).distinct(), "obligation_id").filter(F.coalesce("deadline", F.lit("")) != "").select("obligation_id", "deadline")
    sizes = hit.groupBy("deadline").agg(F.ceil(F.count(F.lit(1)) / block_ids).cast("int").alias("blocks"))
    number = F.conv(F.substring(F.md5(F.col("obligation_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("int")
    dealt = hit.join(sizes, "deadline").withColumn("block", number % F.col("blocks"))
    return dealt.groupBy("deadline", "block", "blocks").agg(F.count(F.lit(1)).alias("obligation_count"), F.array_sort(F.collect_list("obligation_id")).alias("ids"))


def effort_totals(spread: DataFrame, register: DataFrame) -> DataFrame:
    """Affected obligations by effort class with their weights 3, 2 and 1."""
    from statuta.functions.fields import effort

    hit = register.join(spread.select(F.col("node").alias("obligation_id")).distinct(), "obligation_id")
    weight = F.when(F.col("effort") == "high", 3).when(F.col("effort") == "medium", 2).otherwise(1)
    return hit.withColumn("effort", effort(F.col("description"), L.IMPACT_EFFORT)).groupBy("effort").agg(F.count(F.lit(1)).alias("obligations"), F.sum(weight).alias("effort_points"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(obligation_id, in_degree, out_degree) of every node."""
    into = edges.groupBy(F.col("dst").alias("obligation_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("obligation_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return nodes.join(into, "obligation_id", "left").join(out, "obligation_id", "left").fillna(0, ["in_degree", "out_degree"])


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree 2E/N and density E/N."""
    both = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))))
    n = F.greatest("nodes", F.lit(1))
    return both.select("nodes", "edges", F.bround(2 * F.col("edges") / n, 2).alias("avg_degree"), (F.col("edges") / n).alias("density"))


def peel(edges: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, int]:
    """Edges left after removing, round after round, all edges out of nodes without incoming ones; and the rounds."""
    left, rounds = materialize(edges.select("src", "dst").distinct(), "peel"), 0
    while rounds < max_rounds:
        rest = materialize(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "peel")
        if rest.count() == left.count():
            break
        left, rounds = rest, rounds + 1
    return left, rounds


def is_acyclic(edges: DataFrame) -> bool:
    return peel(edges)[0].isEmpty()


def longest_path(edges: DataFrame) -> int:
    """Edges on the longest path; 0 where there is a cycle. Each round of peeling takes one edge off every longest path."""
    left, rounds = peel(edges)
    return rounds if left.isEmpty() else 0


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None, max_depth: int = 1_000) -> DataFrame:
    """(obligation_id, betweenness), directed, over (n-1)(n-2); with ``sources`` (column root), scaled up from them.

    Brandes' sums by rounds of joins: levels and path counts of all sources at once going out, shares of
    dependency coming back.
    """
    step = materialize(edges.select("src", "dst").distinct().filter("src <> dst"), "edges")
    roots = nodes.select(F.col("obligation_id").alias("root")) if sources is None else sources.select("root")
    n, used = nodes.count(), roots.count()
    level = materialize(roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("paths"), F.lit(0).alias("depth")), "level")
    levels, nears, seen = [level], [], level.select("root", "node")
    while len(levels) < max_depth:
        near = edges_out_of(step, level)
        nears.append(near)
        nxt = level.join(near, level["node"] == near["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = materialize(not_seen(nxt, seen, near).withColumn("depth", F.lit(len(levels))), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("root", "node"))
    shares = levels[-1].select("root", "node", "paths", F.lit(0.0).alias("share"))
    total = shares
    for upper, near in reversed(list(zip(levels[:-1], nears))):
        low = shares.select("root", F.col("node").alias("dst"), F.col("paths").alias("low_paths"), F.col("share").alias("low_share"))
        up = upper.join(near, upper["node"] == near["src"]).join(low, ["root", "dst"])
        got = up.groupBy("root", "node").agg(F.sum(F.col("paths") / F.col("low_paths") * (1 + F.col("low_share"))).alias("share"))
        shares = materialize(upper.join(got, ["root", "node"], "left").select("root", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "shares")
        total = total.unionByName(shares)
    scale = n / used / ((n - 1) * (n - 2)) if n > 2 and used else 0.0
    sums = total.filter("root <> node").groupBy(F.col("node").alias("obligation_id")).agg((F.sum("share") * scale).alias("betweenness"))
    return nodes.join(sums, "obligation_id", "left").fillna(0.0, ["betweenness"])


def top_nodes(values: DataFrame, column: str, k: int = 5) -> DataFrame:
    return values.orderBy(F.desc(column), "obligation_id").limit(k)


def cards(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root: sorted direct dependents, direct dependencies and transitive dependents, with counts."""
    gather = lambda df, name: df.groupBy("root").agg(F.array_sort(F.collect_set("node")).alias(name))
    out = roots.select("root")
    for name, df in (("dependents", direct_dependents(edges, roots)), ("dependencies", direct_dependencies(edges, roots)), ("transitive", reachable(edges, roots).select("root", "node"))):
        out = out.join(gather(df, name), "root", "left").withColumn(name, F.coalesce(name, F.array().cast(edges.select(F.collect_set("dst")).schema[0].dataType))).withColumn(f"n_{name}", F.size(name))
    return out


def export_nodes(register: DataFrame) -> DataFrame:
    """Node rows for export; evidence_count is the number of requirements."""
    return register.select("obligation_id", "title", "severity", "status", "evidence_status", "circular_id", F.size("evidence_requirements").alias("evidence_count"))


def export_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.coalesce("edge_type", F.lit("related")).alias("edge_type"), "weight")


def deduplicate(edges: DataFrame, order: str) -> DataFrame:
    """One edge per (src, dst), the last by ``order``."""
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def propagate_direct(edges: DataFrame) -> DataFrame:
    """(root, node, kind) where every obligation that has dependents has changed: all that is affected is then direct."""
    return edges.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit("direct").alias("kind")).distinct()
