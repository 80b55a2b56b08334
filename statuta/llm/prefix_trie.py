"""The prefix trie of conversations: shared first turns are one node, with its members and the totals of its subtree.

A turn is known by the SHA-256 of its role and text. A prefix is known by sums over its turns of hashes of (place, turn), 128 bits
in four sums; sums can be taken in parts, so a conversation that holds a third of all turns is dealt to many tasks. Texts do not
move: only digests, lengths and ids do. Totals come from parallel tree contraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm.common import materialize
from statuta.llm.tree_contraction import subtree_totals

KEY = ["k0", "k1", "k2", "k3"]
#: Turns of one conversation that are summed in one group.
CHUNK = 1024
#: Conversation ids that are joined to one text before they are hashed.
BLOCK = 65_536


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, chars) of every turn, by turn, null first; equal turns by their digest.

    Null role or text is empty; rows without conv_id are no conversation. Turns are dealt by range, so that those of one
    conversation may lie in many parts; a part's first place is the number of turns in the parts before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    dealt = materialize(turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest").withColumn("part", F.spark_partition_id()), "turns-dealt")
    counts = dealt.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("part", "conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    placed = dealt.withColumn("pos", F.row_number().over(order).cast("long") - 1).join(offsets, ["part", "conv_id"])
    return materialize(placed.select("conv_id", (F.col("pos") + F.col("offset")).alias("pos"), "digest", "chars"), "turns-numbered")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, members) after conversation c has taken its first h turns from conversation c - c % every; h = crc32(c) % most.

    ``turns`` is ``numbered``; members has conv_id and n, its number of turns, also where it is 0. The remainder has the sign of c.
    """
    c = F.col("conv_id")
    h = F.crc32(c.cast("string")) % most
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumn("h", h).withColumn("base", c - c % every)
    sizes = materialize(sizes, "conversations")
    bases = sizes.filter(c % every == 0).select(c.alias("base"), F.col("own").alias("base_n"))
    members = sizes.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    members = materialize(members.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "members")
    kept = turns.filter(F.col("pos") >= h).join(members.select("conv_id", "h", "taken", "n"), "conv_id")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars", "n")
    heads = turns.filter((c % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    lent = heads.join(members.select("conv_id", "base", "taken", "n"), "base").filter(F.col("pos") < F.col("taken"))
    return materialize(kept.unionByName(lent.select("conv_id", "pos", "digest", "chars", "n")), "turns-rebuilt"), members.select("conv_id", "n")


def unchanged(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of conversations as they are."""
    members = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "members")
    return materialize(turns.join(members, "conv_id"), "turns-as-they-are"), members


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, ends, key of the prefix up to the turn, key of the one before) of every turn."""
    half = lambda salt, shift: F.shiftrightunsigned(F.xxhash64(F.lit(salt), "pos", "digest"), shift).bitwiseAND(0xFFFFFFFF)
    lanes: list[Column] = [half(salt, shift).alias(f"own{2 * salt + (shift > 0)}") for salt in (0, 1) for shift in (0, 32)]
    rows = turns.select("conv_id", "pos", "chars", "n", F.floor(F.col("pos") / CHUNK).alias("chunk"), *lanes)
    chunks = rows.groupBy("conv_id", "chunk").agg(*[F.sum(f"own{i}").alias(f"sum{i}") for i in range(4)])
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.select("conv_id", "chunk", *[F.coalesce(F.sum(f"sum{i}").over(before), F.lit(0)).alias(f"base{i}") for i in range(4)])
    within = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(f"own{i}").over(within).alias(f"run{i}") for i in range(4)]).join(bases, ["conv_id", "chunk"])
    return summed.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "chars", (F.col("pos") + 1 == F.col("n")).alias("ends"),
        *[(F.col(f"base{i}") + F.col(f"run{i}")).alias(f"k{i}") for i in range(4)], *[(F.col(f"base{i}") + F.col(f"run{i}") - F.col(f"own{i}")).alias(f"p{i}") for i in range(4)],
    )


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts joined by commas; a key's rows come one after the other, so one hash is open at a time."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in key], pa.array([state.hexdigest()])], [*KEY, "ends_sha256"])
    for batch in batches:
        done = []
        for *k, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append(row())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key is not None:
        yield row()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the conversations (conv_id) that end at each key: ids in blocks of bounded size, hashed one block after the other."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    blocks = ends.groupBy(*KEY, F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids").mapInArrow(_hash_lists, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root (depth 0) has all members, also those without turns; without any member there is no root and no row.
    """
    rows = materialize(prefixes(turns), "prefixes")
    stems = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), *[F.min(f"p{i}").alias(f"p{i}") for i in range(4)])
    zeros = [F.lit(0).cast("long").alias(k) for k in KEY]
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*zeros, "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("depth", "chars")], *[F.lit(None).cast("long").alias(f"p{i}") for i in range(4)])
    kids = rows.select(*KEY, *[f"p{i}" for i in range(4)]).distinct().groupBy(*[F.col(f"p{i}").alias(k) for i, k in enumerate(KEY)]).agg(F.count(F.lit(1)).alias("n_children"))
    ends = end_hashes(rows.filter("ends").select(*KEY, "conv_id").unionByName(members.filter("n = 0").select(*zeros, "conv_id")))
    nodes = stems.unionByName(root).join(kids, KEY, "left").join(ends, KEY, "left")
    nodes = materialize(nodes.fillna(0, "n_children").withColumn("node", F.monotonically_increasing_id()), "nodes")
    # a parent of very many children is one row that meets them all; adaptive execution splits the children's side
    above = nodes.select(*[F.col(k).alias(f"p{i}") for i, k in enumerate(KEY)], F.col("conv_id").alias("parent_conv_id"), F.col("node").alias("parent"))
    nodes = materialize(nodes.join(above, [f"p{i}" for i in range(4)], "left").drop(*KEY, *[f"p{i}" for i in range(4)]), "nodes-linked")
    leaf = (F.col("n_children") == 0).cast("long")
    totals = subtree_totals(nodes.select(F.col("node").alias("id"), "parent", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    out = nodes.join(totals.withColumnRenamed("id", "node"), "node")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild_every: int | None = None, rebuild_most: int = 6) -> DataFrame:
    """``trie`` of a table of conv_id, turn, role and text; with ``rebuild_every``, of conversations that share their first turns (``rebuilt``).

    Null role or text is empty, a null turn comes first, equal turns go by content, repeated rows are turns of their own, rows
    without conv_id are left out, an empty table gives no rows, other columns do not matter.
    """
    turns = numbered(conversations)
    return trie(*(rebuilt(turns, rebuild_every, rebuild_most) if rebuild_every else unchanged(turns)))
