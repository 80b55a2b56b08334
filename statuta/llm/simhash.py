"""SimHash near-dedup with BK-trees over shards of fingerprints.

A fingerprint bit is set where more than half of the shingle hashes of a text set it. Fingerprints within
``radius`` bits are linked, and the components of the links are the groups.

Only distinct fingerprints are compared, so copies cost nothing here. With ``radius`` differing bits spread
over ``radius + 1`` blocks of bits, at least one block is equal; so each fingerprint goes to one shard for
each block, keyed by that block's bits, and every link lies whole in some shard. For very many fingerprints
there are more blocks, and two or more of them make a key, so that shards stay of about the same size.

In each shard, whatever its size, a BK-tree holds the fingerprints, children keyed by their Hamming distance to the
parent; a search follows only the edges within the radius of the distance to the node, and no edge below
which all are found already. What is found is searched for next and is not found again, so a dense shard of
n gives about n links, never all pairs, and no component is cut.

A shard of more than ``shard_rows`` fingerprints is dealt again by further blocks of its bits, which is linear in
its rows and loses no link; only what stays together even then (a dense cloud around one text) and is still larger is dealt
into parts, each pair of parts a task. Trees are built where their shard's rows are, so they travel by
shuffle: their number grows with the corpus and has no bound that would allow a broadcast.

The links are joined into components by rounds of joins over shared tables, none of it on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import materialize

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LANES = np.uint64(0x0101010101010101)


def hashes_of(text: str | None, size: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words) - size + 1
    if not words:
        return np.empty(0, np.uint64)
    if n <= 1:
        return np.asarray([xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    view = memoryview(whole)
    return np.fromiter((xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[:n].tolist(), (ends[size - 1 :] - 1).tolist())), np.uint64, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits, least first."""
    out = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):  # a byte lane holds counts up to 255
        part = h[at : at + 255]
        for shift in range(8):
            lanes = ((part >> np.uint64(shift)) & _LANES).sum(dtype=np.uint64)
            out[shift::8] += np.frombuffer(np.uint64(lanes).astype("<u8").tobytes(), np.uint8)
    return out


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint as an unsigned number; 0 for a text without words."""
    h = hashes_of(text, size, seed)
    if not len(h):
        return 0
    return int(np.packbits(2 * bit_counts(h) > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, tag: str | None = None) -> DataFrame:
    """doc_id, the long column ``tag`` where one is named, and fp (the fingerprint's bits as a signed long) of every row."""
    names = ["doc_id", tag] if tag else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray([fingerprint(t.as_py(), size, seed) for t in batch.column(len(names))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp.view(np.int64))], [*names, "fp"])

    columns = [F.col(c).cast("long").alias(c) for c in names]
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


class BKForest:
    """BK-trees over 64-bit numbers, one for each group; equal numbers may be in several groups, not twice in one.

    All trees lie in the same arrays and are grown and searched together, level by level. ``group`` is sorted.
    Node i is the number ``values[i]``; ``child_code`` sorts the children by (parent, distance to the parent).
    """

    def __init__(self, group: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values, self.n = values, n
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [n])))
        self.group = np.repeat(np.arange(len(starts)), sizes)
        self.root = np.repeat(starts, sizes)
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.visits = 0
        self._grow()

    def _grow(self) -> None:
        """Each number goes down from its root; the first to come to a free edge becomes the child there."""
        moving = np.flatnonzero(self.root != np.arange(self.n))
        at = self.root[moving]
        while len(moving):
            distance = np.bitwise_count(self.values[moving] ^ self.values[at]).astype(np.int64)
            code = at * 65 + distance
            order = np.argsort(code, kind="stable")
            first = np.concatenate(([True], code[order][1:] != code[order][:-1]))
            child = moving[order][first]
            self.parent[child], self.edge[child] = at[order][first], distance[order][first]
            at = np.empty_like(at)
            at[order] = child[np.cumsum(first) - 1]
            on = at != moving
            moving, at = moving[on], at[on]
        inner = np.flatnonzero(self.parent >= 0)
        code = self.parent[inner] * 65 + self.edge[inner]
        order = np.argsort(code)
        self.child_code, self.child = code[order], inner[order]
        self.alive = np.ones(self.n, bool)
        self.below = np.ones(self.n, np.int64)  # how many in the subtree are still to be found, itself included
        depth, level, at = np.zeros(self.n, np.int64), 0, inner
        up = self.parent[inner]
        while len(at):
            depth[at] += 1
            on = self.parent[up] >= 0
            at, up = at[on], self.parent[up[on]]
            level += 1
        for d in range(level, 0, -1):
            nodes = np.flatnonzero(depth == d)
            np.add.at(self.below, self.parent[nodes], self.below[nodes])

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of alive nodes of the query's tree within ``radius``."""
        q, at = queries, self.root[queries]
        found_q, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(q):
            self.visits += len(q)
            d = np.bitwise_count(self.values[q] ^ self.values[at]).astype(np.int64)
            hit = (d <= radius) & self.alive[at]
            found_q.append(q[hit])
            found.append(at[hit])
            # only the edges from d - radius to d + radius
            low = np.searchsorted(self.child_code, at * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.child_code, at * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            place = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at, q = self.child[place], np.repeat(q, n)
            on = self.below[at] > 0
            at, q = at[on], q[on]
        return np.concatenate(found_q), np.concatenate(found)

    def take(self, nodes: np.ndarray) -> None:
        """These alive nodes are not to be found any more."""
        self.alive[nodes] = False
        while len(nodes):
            np.subtract.at(self.below, nodes, 1)
            up = self.parent[nodes]
            nodes = up[up >= 0]

    def links(self, radius: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """Links (places) that connect just what the pairs within ``radius`` connect, in each group.

        Each node is searched for once: of each group up to ``width`` at a time of those that were found, else one
        other. So a group has one component under way at a time, and one link to each found node is enough.
        """
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        pending, waiting = np.arange(self.n), np.zeros(self.n, bool)

        def first_of_groups(nodes: np.ndarray, width: int) -> np.ndarray:
            if not len(nodes):
                return nodes
            g = self.group[nodes]
            starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            rank = np.arange(len(nodes)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(nodes)]))))
            return nodes[rank < width]

        while len(pending):
            found_before = waiting[pending]
            now, fresh = first_of_groups(pending[found_before], width), pending[~found_before]
            busy = np.zeros(self.group[-1] + 1, bool)
            busy[self.group[now]] = True
            fresh = first_of_groups(fresh[~busy[self.group[fresh]]], 1)
            self.take(fresh)
            asked = np.concatenate((now, fresh))
            q, node = self.search(asked, radius)
            node, first = np.unique(node, return_index=True)
            left.append(q[first])
            right.append(node)
            self.take(node)
            waiting[node] = True
            done = np.zeros(self.n, bool)
            done[asked] = True
            pending = pending[~done[pending]]
        return np.concatenate(left), np.concatenate(right)


def links_of_batches(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by both, none twice -> links (a, b) between fingerprints of a key, about ``rows`` rows at a time."""

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], key[1:] != key[:-1]))
        sizes = np.diff(np.concatenate((np.flatnonzero(new), [len(key)])))
        several = np.repeat(sizes > 1, sizes)  # a single fingerprint has no links
        key, fp = key[several], fp[several]
        a, b = BKForest(key, fp).links(radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])

    keys, fps, held = [], [], 0
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        # the last key of what is held may go on in this batch
        cut = int(np.searchsorted(key, key[-1], "left"))
        if held + cut >= rows and (cut or keys[-1][-1] != key[0]):
            yield links(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
            keys, fps, held = [], [], 0
            key, fp = key[cut:], fp[cut:]
        keys.append(key)
        fps.append(fp)
        held += len(key)
    if held:
        yield links(np.concatenate(keys), np.concatenate(fps))


def blocks_for(n: int, radius: int, usual: int = 64, fewest: int | None = None) -> int:
    """Blocks of bits such that a shard of ``n`` spread-out fingerprints holds no more than about ``usual`` of them.

    With more blocks more of them are equal in any linked pair, so keys are longer and shards smaller; the
    links are the same.
    """
    blocks = fewest or radius + 2
    while blocks < 16 and n > usual << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def block_keys(fp: Column, radius: int, blocks: int, *outer: Column) -> Column:
    """The keys of the shards that a fingerprint goes to: one for each choice of ``blocks - radius`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(*[F.xxhash64(*outer, F.lit(blocks), F.lit(n), fp.bitwiseAND(F.lit(signed(sum(chosen))))) for n, chosen in enumerate(combinations(masks, blocks - radius))])


def links(distinct: DataFrame, radius: int = 4, shard_rows: int = 100_000, blocks: int | None = None, usual: int = 512) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within ``radius``.

    Shards have about ``usual`` fingerprints at most where these are spread out. No shard of over ``shard_rows``
    meets a single task: it is dealt by three more blocks of bits, then into parts. An empty table has no links.
    """
    blocks = blocks or blocks_for(distinct.count(), radius, usual, radius + 1)
    keyed = distinct.select(F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key"), "fp")

    def large(of: DataFrame, name: str) -> DataFrame:
        """The few shards that are too large for one task, and into how many parts each would go."""
        counted = of.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
        return materialize(counted.select("key", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), name)

    hot = large(keyed, "large-shards")
    if not hot.isEmpty():
        by_key = keyed.join(hot, "key", "left")
        again = by_key.filter(F.col("parts").isNotNull()).select(F.explode(block_keys(F.col("fp"), radius, blocks + 3, F.col("key"))).alias("key"), "fp")
        dense = large(again, "dense-shards")
        parted = again.join(dense, "key", "left")
        own = F.pmod(F.xxhash64(F.lit(-1), F.col("fp")), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(j, own), F.greatest(j, own)))
        dealt = parted.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp")
        keyed = by_key.filter(F.col("parts").isNull()).select("key", "fp").unionByName(dealt)
    shards = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return shards.mapInArrow(lambda it: links_of_batches(it, radius), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """The least node reachable from each node that has a link: columns node, root. Edges are (a, b).

    Alternating star rounds: each node hooks its larger neighbours, then its smaller ones, onto the least
    node near it, until no edge changes. Each round's table is written to the shared scratch folder.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        now = materialize(small_star(large_star(now)), "stars")
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def rooted_by(marked: DataFrame, name: Column, radius: int, shard_rows: int) -> DataFrame:
    """Each distinct fingerprint: fp, least (the least ``name`` of its rows) and root, which its whole component shares."""
    distinct = materialize(marked.groupBy("fp").agg(F.min(name).alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, shard_rows))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def groups(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42, shard_rows: int = 100_000) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links.

    Null and blank texts have fingerprint 0 and are linked like any other; null ids take part in links but
    never name a component unless alone (then the id is null); rows that repeat a doc_id stay rows of their
    own; an empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, size, seed), "fingerprints")
    rooted = materialize(rooted_by(marked, F.col("doc_id"), radius, shard_rows), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    several = named.filter("n > 1").select("root", "component_id")
    by_fp = rooted.join(several, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return with_components(marked, by_fp)


def with_components(marked: DataFrame, by_fp: DataFrame) -> DataFrame:
    """Join the component of each fingerprint to the rows. A fingerprint that a third of all rows share makes
    a skewed partition of this join, which adaptive execution splits over tasks."""
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, size: int = 4, seed: int = 42, shard_rows: int = 100_000) -> DataFrame:
    """One row of each group, with all its columns: the one with the least doc_id.

    Rows are told apart by a tag that is written once, not by their ids: of rows that repeat an id just one
    stays, and a row with a null doc_id stays only where its component has no id. Null and blank texts are one
    group. Columns may have any name, since rows travel whole in a struct; an empty table stays empty.
    """
    tagged = materialize(docs.select(F.monotonically_increasing_id().alias("tag"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "tagged")
    marked = materialize(fingerprints(tagged.select("tag", "row.doc_id", "row.text"), size, seed, "tag"), "fingerprints")
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")
    kept = rooted_by(marked, name, radius, shard_rows).groupBy("root").agg(F.min("least").alias("least")).select("least.tag")
    # rows and kept tags meet by shuffle whatever their number, so the plan is the same at every size
    return tagged.join(kept.hint("merge"), "tag", "left_semi").select("row.*")
