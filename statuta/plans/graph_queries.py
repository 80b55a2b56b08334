"""Queries over the graphs: lists of (name, query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.operators import graph as G
from statuta.plans import views as V
from statuta.session import materialize

SUPPLY = "WITH RECURSIVE " + V.SUPPLY_EDGES
REACH = SUPPLY + ", walk(root, node, depth) AS (SELECT src, dst, 1 FROM supply_edges UNION SELECT root, dst, depth + 1 FROM walk JOIN supply_edges ON src = node), reach AS (SELECT root, node, min(depth) depth FROM walk GROUP BY 1, 2)"
UP = SUPPLY + ", walk(root, node, depth) AS (SELECT dst, src, 1 FROM supply_edges UNION SELECT root, src, depth + 1 FROM walk JOIN supply_edges ON dst = node WHERE depth < 2) SELECT root, node, min(depth) - 1 AS hop FROM walk GROUP BY 1, 2"


def roots(edges):  # noqa: ANN001
    return edges.select(F.col("src").alias("root")).distinct()


def direct_dependents(spark, d):
    e = V.order_edges(spark, d)
    return G.direct_dependents(e, roots(e))


def direct_dependencies(spark, d):
    e = V.order_edges(spark, d)
    return G.direct_dependencies(e, e.select(F.col("dst").alias("root")).distinct())


def _supply(spark, d):
    """The supply graph, written once, since roots, steps and nodes are all read from it."""
    return materialize(V.supply_edges(spark, d), "supply")


def transitive_closure(spark, d):
    e = _supply(spark, d)
    return G.reachable(e, roots(e))


def impact_propagation(spark, d):
    e = _supply(spark, d)
    return G.propagate(e, roots(e)).select("root", "node", "kind")


def impact_totals(spark, d):
    e = _supply(spark, d)
    return G.impact_totals(G.propagate(e, roots(e)))


def upstream_depth2(spark, d):
    e = _supply(spark, d)
    return G.upstream(e, V.supply_nodes(e).select(F.col("obligation_id").alias("root")), 2)


def degrees(spark, d):
    e = V.order_edges(spark, d)
    return G.degrees(G.nodes_of(V.register(spark, d), e), e)


def degree_topk(spark, d):
    e = V.supply_edges(spark, d)
    return G.top_nodes(G.degrees(V.supply_nodes(e), e), "in_degree").select("obligation_id", "in_degree")


def graph_density(spark, d):
    e = V.supply_edges(spark, d)
    return G.density(V.supply_nodes(e), e).select("nodes", "edges", F.bround("density", 6).alias("density"))


def longest_path(spark, d):
    e = V.supply_edges(spark, d)
    return e.agg(F.count(F.lit(1)).alias("edges"), F.lit(G.longest_path(e)).alias("longest"))


def is_acyclic(spark, d):
    e = V.order_edges(spark, d)
    back = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", "weight"))
    return e.agg(F.count(F.lit(1)).alias("edges"), F.lit(G.is_acyclic(V.supply_edges(spark, d))).alias("supply"), F.lit(G.is_acyclic(back)).alias("both_ways"))


def betweenness(spark, d):
    """Exact centrality of the supply graph."""
    e = _supply(spark, d)
    return G.betweenness(V.supply_nodes(e), e).select("obligation_id", F.bround("betweenness", 8).alias("betweenness"))


def set_difference_affected(spark, d):
    e = _supply(spark, d)
    spread = G.propagate(e, roots(e)).filter("root like 'p%'")
    return spread.filter("kind = 'indirect'").select("node").distinct().exceptAll(spread.filter("kind = 'direct'").select("node").distinct())


def impact_timeline(spark, d):
    spread = G.propagate_direct(V.order_edges(spark, d))
    return G.timeline(spread, V.register(spark, d)).select("deadline", "obligation_count", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def impact_timeline_blocks(spark, d):
    """The timeline with at most about 50 ids a row, whatever the number of a deadline's obligations."""
    out = G.timeline_blocks(G.propagate_direct(V.order_edges(spark, d)), V.register(spark, d), 50)
    return out.select("deadline", "block", "blocks", "obligation_count", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def effort_totals(spark, d):
    return G.effort_totals(G.propagate_direct(V.order_edges(spark, d)), V.register(spark, d))


def affected_workflows(spark, d):
    return G.affected_workflows(G.propagate_direct(V.order_edges(spark, d)), V.register(spark, d))


def dependency_cards(spark, d):
    e = _supply(spark, d)
    return G.cards(e, V.supply_nodes(e).select(F.col("obligation_id").alias("root"))).select("root", "n_dependents", "n_dependencies", "n_transitive", F.md5(F.array_join("transitive", ",")).alias("transitive"))


QUERIES = [
    (direct_dependents, "WITH " + V.ORDER_EDGES + " SELECT src AS root, dst AS node FROM order_edges"),
    (direct_dependencies, "WITH " + V.ORDER_EDGES + " SELECT dst AS root, src AS node FROM order_edges"),
    (transitive_closure, REACH + " SELECT * FROM reach"),
    (impact_propagation, REACH + " SELECT root, node, CASE depth WHEN 1 THEN 'direct' ELSE 'indirect' END kind FROM reach"),
    (impact_totals, REACH + " SELECT count(DISTINCT node) FILTER (depth = 1) direct, count(DISTINCT node) FILTER (depth > 1) indirect, count(DISTINCT node) FILTER (depth = 1) + count(DISTINCT node) FILTER (depth > 1) total FROM reach"),
    (upstream_depth2, UP),
    (degrees, "WITH " + V.ORDER_EDGES + ", o AS (SELECT src, count(*) n FROM order_edges GROUP BY 1), i AS (SELECT dst, count(*) n FROM order_edges GROUP BY 1) SELECT o_orderkey obligation_id, coalesce(i.n, 0) in_degree, coalesce(o.n, 0) out_degree FROM orders LEFT JOIN o ON src = o_orderkey LEFT JOIN i ON dst = o_orderkey"),
    (degree_topk, SUPPLY + " SELECT dst obligation_id, count(*) in_degree FROM supply_edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    (graph_density, SUPPLY + " SELECT (SELECT count(*) FROM supply_nodes) nodes, count(*) edges, round_even(count(*) / (SELECT count(*) FROM supply_nodes)::DOUBLE, 6) density FROM supply_edges"),
    (longest_path, REACH + " SELECT (SELECT count(*) FROM supply_edges) edges, max(depth) longest FROM walk"),
    (is_acyclic, "WITH " + V.ORDER_EDGES + " SELECT count(*) edges, true supply, count(*) = 0 both_ways FROM order_edges"),
    (
        betweenness,
        SUPPLY
        + """, paths(s, t, v, len, trail) AS (SELECT src, dst, dst, 1, [src, dst] FROM supply_edges UNION ALL SELECT s, e.dst, e.dst, len + 1, list_append(trail, e.dst) FROM paths JOIN supply_edges e ON e.src = v),
  least AS (SELECT s, t, min(len) m FROM paths GROUP BY 1, 2), short AS (SELECT p.s, p.t, p.trail FROM paths p JOIN least l ON l.s = p.s AND l.t = p.t AND p.len = l.m), total AS (SELECT s, t, count(*) n FROM short GROUP BY 1, 2),
  inner_nodes AS (SELECT s, t, unnest(trail[2:-2]) v FROM short), dep AS (SELECT v, sum(1.0::DOUBLE / n) b FROM inner_nodes JOIN total USING (s, t) GROUP BY 1), k AS (SELECT count(*) n FROM supply_nodes)
  SELECT id obligation_id, round_even(coalesce(b, 0) / ((n - 1) * (n - 2)), 8) betweenness FROM supply_nodes LEFT JOIN dep ON v = id, k""",
    ),
    (set_difference_affected, REACH + " SELECT DISTINCT node FROM reach WHERE root LIKE 'p%' AND depth > 1 AND node NOT IN (SELECT node FROM reach WHERE root LIKE 'p%' AND depth = 1)"),
    (impact_timeline, "WITH " + V.REGISTER + ", " + V.ORDER_EDGES + " SELECT deadline, count(*) obligation_count, string_agg(obligation_id, ',' ORDER BY obligation_id) ids FROM register WHERE obligation_id IN (SELECT dst FROM order_edges) GROUP BY 1"),
    (
        impact_timeline_blocks,
        "WITH " + V.REGISTER + ", " + V.ORDER_EDGES + """, h AS (SELECT obligation_id, deadline FROM register WHERE obligation_id IN (SELECT dst FROM order_edges)), c AS (SELECT deadline, CAST(ceil(count(*) / 50.0) AS INTEGER) AS blocks FROM h GROUP BY 1)
  SELECT deadline, CAST('0x' || md5(CAST(obligation_id AS VARCHAR))[1:7] AS INTEGER) % blocks AS "block", any_value(blocks) AS blocks, count(*) obligation_count, string_agg(obligation_id, ',' ORDER BY obligation_id) ids FROM h JOIN c USING (deadline) GROUP BY 1, 2""",
    ),
    (effort_totals, "WITH " + V.REGISTER + ", " + V.ORDER_EDGES + " SELECT 'high' effort, count(*) obligations, 3 * count(*) effort_points FROM register WHERE obligation_id IN (SELECT dst FROM order_edges)"),
    (affected_workflows, "WITH " + V.REGISTER + ", " + V.ORDER_EDGES + " SELECT DISTINCT w AS workflow FROM (SELECT unnest(keywords) w FROM register WHERE obligation_id IN (SELECT dst FROM order_edges)) WHERE w LIKE '%risk%'"),
    (
        dependency_cards,
        REACH
        + """ SELECT id AS root, (SELECT count(*) FROM supply_edges WHERE src = id) n_dependents, (SELECT count(*) FROM supply_edges WHERE dst = id) n_dependencies, (SELECT count(*) FROM reach WHERE reach.root = id) n_transitive,
  md5(coalesce((SELECT string_agg(node, ',' ORDER BY node) FROM reach WHERE reach.root = id), '')) transitive FROM supply_nodes""",
    ),
]
