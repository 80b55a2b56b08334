"""Subtree totals of a forest of any shape by parallel tree contraction, in join rounds.

A round rakes and compresses. Rake: every leaf's total is final, is added to its parent and the leaf goes. Compress: every
chain of nodes with one child is followed by pointer jumping (each node learns the sum down to the node below its chain and that
node), then the whole chain goes, its sum to the node above. What is left has no node with one child, so a round leaves at most
half of the nodes: as many rounds as the logarithm of the nodes, and within a round as many jumps as the logarithm of the
longest chain. At last the chains are expanded again, last round first: a node's total is its sum plus the total of the
node below its chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import materialize


def subtree_totals(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """(id, the summed values of the node and all below it) of every node.

    ``nodes`` has the columns id (unique, not null), parent (an id, or null at a root) and ``values`` (long; null
    counts as 0). Other columns are left out; an empty table gives none. Ids on a circle have no root and no total, which is an error.
    """
    v, zero = [f"v{i}" for i in range(len(values))], F.lit(0).cast("long")
    sums = lambda prefix="": [F.sum(f"{prefix}{x}").alias(x) for x in v]
    alive = materialize(nodes.select("id", "parent", *[F.coalesce(F.col(c).cast("long"), zero).alias(x) for c, x in zip(values, v)]), "tree")
    left = alive.count()
    leaves: list[DataFrame] = []
    chains: list[DataFrame] = []  # of each round: (id, next, sums down to next)
    while left:
        parents = alive.filter("parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("inner", F.lit(True))
        marked = materialize(alive.join(parents, "id", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "tree-marked")
        leaves.append(marked.filter("not inner").select("id", *v))
        inner = marked.filter("inner").drop("inner")
        # rake, and what compress has to know: how many inner children a node has, and which if it is one
        told = marked.filter("parent is not null").select(
            F.col("parent").alias("id"), *[F.when(F.col("inner"), zero).otherwise(F.col(x)).alias(f"add_{x}") for x in v],
            F.col("inner").cast("int").alias("one"), F.when(F.col("inner"), F.col("id")).alias("child"),
        )
        told = told.groupBy("id").agg(*[F.sum(f"add_{x}").alias(f"add_{x}") for x in v], F.sum("one").alias("n"), F.min("child").alias("child"))
        state = materialize(inner.join(told, "id").select("id", "parent", *[(F.col(x) + F.col(f"add_{x}")).alias(x) for x in v], "n", "child"), "tree-raked")
        chain = state.filter("n = 1").select("id", "parent", F.col("child").alias("next"), *v)
        rest = state.filter("n <> 1").select("id", "parent", *v)
        followed = _follow(chain.drop("parent"), v, left)
        if followed is None:
            alive = materialize(rest, "tree")
        else:
            chains.append(followed)
            first = chain.select("id", F.col("parent").alias("above")).join(chain.select(F.col("next").alias("id")), "id", "left_anti").join(followed, "id")
            moved = first.select(F.col("next").alias("id"), F.lit(True).alias("moved"), "above", *[zero.alias(f"add_{x}") for x in v])
            up = first.filter("above is not null").groupBy(F.col("above").alias("id")).agg(*[F.sum(x).alias(f"add_{x}") for x in v])
            # a node below a chain takes the place of the chain's first node; the node above gets the chain's sum
            news = moved.unionByName(up, allowMissingColumns=True).groupBy("id").agg(F.max("moved").alias("moved"), F.max("above").alias("above"), *[F.sum(f"add_{x}").alias(f"add_{x}") for x in v])
            parent: Column = F.when(F.col("moved"), F.col("above")).otherwise(F.col("parent"))
            alive = materialize(rest.join(news, "id", "left").select("id", parent.alias("parent"), *[(F.col(x) + F.coalesce(f"add_{x}", zero)).alias(x) for x in v]), "tree")
        now = alive.count()
        if now >= left:
            raise ValueError("parents form a circle, or an id is repeated")
        left = now
    totals = None
    for k, found in enumerate(leaves):
        totals = found if totals is None else totals.unionByName(found)
    for followed in reversed(chains):
        below = totals.select(F.col("id").alias("next"), *[F.col(x).alias(f"below_{x}") for x in v])
        opened = followed.join(below, "next").select("id", *[(F.col(x) + F.col(f"below_{x}")).alias(x) for x in v])
        totals = totals.unionByName(materialize(opened, "tree-expanded"))
    if totals is None:
        totals = alive.select("id", *v)
    return totals.select("id", *[F.col(x).alias(c) for c, x in zip(values, v)])


def _follow(chain: DataFrame, v: Sequence[str], nodes: int) -> DataFrame | None:
    """(id, next, sums) of nodes with one child, ``next`` being the first node below that has none or several; None without such nodes.

    Each jump doubles the distance that a node looks ahead; nodes that have arrived are written once and jump no more.
    """
    arrived: DataFrame | None = None
    active = chain
    for _ in range(nodes.bit_length() + 1):  # a chain of all nodes takes so many jumps
        ahead = active if arrived is None else active.unionByName(arrived)
        ahead = ahead.select(F.col("id").alias("next"), F.col("next").alias("then"), *[F.col(x).alias(f"more_{x}") for x in v])
        jumped = active.join(ahead, "next", "left").select(
            "id", F.coalesce("then", "next").alias("next"), *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0).cast("long"))).alias(x) for x in v], F.col("then").isNotNull().alias("open")
        )
        jumped = materialize(jumped, "tree-jumped")
        here = jumped.filter("not open").drop("open")
        arrived = here if arrived is None else arrived.unionByName(here)
        active = jumped.filter("open").drop("open")
        if not active.head(1):
            return arrived if arrived.head(1) else None
    raise ValueError("parents form a circle")
