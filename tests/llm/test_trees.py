"""BK-trees: each tree is searched edge by edge, at every size of shard, and links what pairs link."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm.simhash import BKForest, fingerprints, keep_one, links_of_batches
from tests.llm.test_operators import brute_components

DIR = "/root/testdata/sf0.1"


def cloud(rng, n, per, spread):
    values = {rng.getrandbits(64) for _ in range(n)}
    for center in sorted(values)[:3]:
        for _ in range(per):
            v = center
            for _ in range(rng.randint(1, spread)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    return sorted(values)


@pytest.mark.parametrize("seed", range(30))
def test_forest_links_what_pairs_link(seed):
    rng = random.Random(seed)
    groups = [cloud(rng, rng.randint(1, 30), rng.randint(0, 60), 9) for _ in range(rng.randint(1, 5))]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    forest = BKForest(group, np.asarray([v for g in groups for v in g], np.uint64))
    a, b = forest.links(4, rng.choice([1, 3, 16]))
    assert len(a) < len(group) and (group[a] == group[b]).all()
    start = 0
    for g in groups:
        parent = {v: v for v in g}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            if start <= x < start + len(g):
                assert (g[x - start] ^ g[y - start]).bit_count() <= 4
                parent[find(g[x - start])] = find(g[y - start])
        want = brute_components([(v, v) for v in g], 4)
        assert len({find(v) for v in g}) == len(set(want.values())) and all(want[x] == want[find(x)] for x in g)
        start += len(g)


def test_children_are_keyed_by_distance_and_few_nodes_are_visited():
    rng = random.Random(5)
    values = np.asarray(cloud(rng, 3000, 0, 1), np.uint64)
    forest = BKForest(np.zeros(len(values), np.int64), values)
    inner = np.flatnonzero(forest.parent >= 0)
    assert len(inner) == len(values) - 1 and (np.bitwise_count(values[inner] ^ values[forest.parent[inner]]) == forest.edge[inner]).all()
    assert len(set(zip(forest.parent[inner].tolist(), forest.edge[inner].tolist()))) == len(inner)
    q, found = forest.search(np.arange(200), 4)
    assert forest.visits < 200 * len(values) / 2
    assert {(x, y) for x, y in zip(q.tolist(), found.tolist())} == {(x, y) for x in range(200) for y in range(len(values)) if (int(values[x]) ^ int(values[y])).bit_count() <= 4}


def test_a_dense_cloud_gives_few_links_and_few_visits():
    rng = np.random.default_rng(2)
    flips = np.where(rng.random((40_000, 3)) < 0.8, np.uint64(1) << rng.integers(0, 64, (40_000, 3)).astype(np.uint64), np.uint64(0))
    values = np.unique(np.bitwise_xor.reduce(flips, axis=1))
    forest = BKForest(np.zeros(len(values), np.int64), values)
    a, _ = forest.links(4)
    assert len(a) == len(values) - 1 and forest.visits < 20 * len(values)


def test_every_shard_of_the_whole_table_is_searched_through_its_tree(spark, monkeypatch):
    """All links of a whole table come from forests, and each shard of two or more is a tree."""
    import pyarrow as pa

    from statuta.llm.simhash import block_keys

    fps = fingerprints(spark.read.parquet(f"{DIR}/documents.parquet")).select("fp").distinct()
    keyed = fps.select(F.explode(block_keys(F.col("fp"), 4, 5)).alias("key"), "fp").orderBy("key", "fp").toPandas()
    seen = []
    search = BKForest.search
    monkeypatch.setattr(BKForest, "search", lambda self, q, r: (seen.append(len(q)), search(self, q, r))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(keyed["key"]), pa.array(keyed["fp"])], ["key", "fp"])
    out = list(links_of_batches(iter([batch.slice(0, 7000), batch.slice(7000)]), 4, rows=5000))
    several = keyed.groupby("key")["fp"].transform("size")
    assert sum(seen) == int((several > 1).sum()) > 500
    assert sum(b.num_rows for b in out) > 20


def test_large_shards_are_dealt_again(spark):
    from statuta.llm.simhash import components, links

    rng = random.Random(9)
    values = cloud(rng, 60, 250, 5)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components([(v, v % (1 << 64)) for v in signed], 4)
    for shard_rows in (5, 60, 100_000):
        got = {r.node: r.root for r in components(links(df, 4, shard_rows)).collect()}
        assert {v: got.get(v, v) for v in signed} == {v: want[v % (1 << 64)] for v in signed}


def test_keep_one_with_any_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "A b c d e", "y"), (3, None, "z"), (4, "", "v"), (None, "q r s t", "w")], "doc_id long, text string, _kept string")
    more = df.withColumns({n: F.lit(n) for n in ("tag", "row", "fp", "root", "least", "no_id", "_tag", "a.b")})
    got = keep_one(more)
    assert got.columns == more.columns and sorted(((r.doc_id, r._kept, r.row) for r in got.collect()), key=str) == [(1, "x", "row"), (3, "z", "row"), (None, "w", "row")]
    assert keep_one(more.limit(0)).count() == 0
