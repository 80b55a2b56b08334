"""Prefix trie and tree contraction against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from statuta.llm import prefix_trie as P
from statuta.llm.tree_contraction import subtree_totals

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_totals(parent, values):
    total = dict(values)
    depth = {}

    def level(i):
        if i not in depth:
            depth[i] = 0 if parent[i] is None else None
            path = [i]
            while depth[path[-1]] is None:
                up = parent[path[-1]]
                if up not in depth:
                    depth[up] = 0 if parent[up] is None else None
                path.append(up)
            for k in range(len(path) - 2, -1, -1):
                depth[path[k]] = depth[path[k + 1]] + 1
        return depth[i]

    for i in sorted(parent, key=level, reverse=True):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    return total


def trees():
    rng = random.Random(3)
    yield {i: i - 1 if i else None for i in range(700)}  # a path
    yield {i: 0 if i else None for i in range(500)}  # a star
    yield {i: None if i == 0 else (i - 1 if i < 100 else i - 100) for i in range(200)}  # a comb
    yield {i: rng.randrange(i) if i else None for i in range(600)}
    yield {i: rng.randrange(max(0, i - 3), i) if i else None for i in range(600)}  # deep
    yield {i: None if i % 50 == 0 else i - 1 - rng.randrange(i % 50) for i in range(500)}  # a forest
    yield {0: None}


def test_totals(spark):
    parent = {1000 * k + i: None if p is None else 1000 * k + p for k, tree in enumerate(trees()) for i, p in tree.items()}
    shuffled = list(parent)
    random.Random(1).shuffle(shuffled)
    rename = dict(zip(parent, shuffled))  # ids say nothing of the shape
    parent = {rename[i]: None if p is None else rename[p] for i, p in parent.items()}
    value = {i: i % 7 for i in parent}
    df = spark.createDataFrame([(i, p, value[i], 1 if i % 5 else None, "x") for i, p in parent.items()], "id long, parent long, a long, b long, v0 string")
    got = {r["id"]: (r["a"], r["b"]) for r in subtree_totals(df, ["a", "b"]).collect()}
    one, two = brute_totals(parent, value), brute_totals(parent, {i: int(i % 5 > 0) for i in parent})
    assert got == {i: (one[i], two[i]) for i in parent}


def test_no_nodes_and_circles(spark):
    assert subtree_totals(spark.createDataFrame([], "id long, parent long, a long"), ["a"]).count() == 0
    with pytest.raises(ValueError):
        subtree_totals(spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, 3, 0), (5, 1, 0), (6, 2, 0)], "id long, parent long, a long"), ["a"])


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, every=100, most=6):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), digest(role or "", text or ""), role or "", text or ""))
    for c in turns:
        turns[c].sort()
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most if every else 0
        base = turns.get(c - c % every, []) if every else []
        built[c] = tuple((r, x) for _, _, r, x in [*base[:h], *own[h:]])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def hard_rows():
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 130), 205, 317, 400, 401, 402, 1_000_100, 1_000_199]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", None, "", "é\U0001f600", "long " * 400])))
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(7)]  # a hot group of equal conversations
    rows += [(3, None, "user", "first"), (3, None, "user", "before it"), (4, 1, "user", "tie"), (4, 1, "user", "eit"), (5, 0, "x", "y"), (5, 0, "x", "y"), (None, 0, "user", "of none")]
    rows += [(700, t, "user", str(t % 3)) for t in range(2500)] + [(701, t, "user", str(t % 3)) for t in range(2300)]  # longer than a chunk
    return rows


def test_trie_of_hard_rows(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(P.prefix_trie(df, 100, 6)) == brute(rows)


def test_trie_without_rebuilding_and_clashing_columns(spark):
    rows = [r for r in hard_rows() if r[0] is None or r[0] < 700]
    df = spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA + ", digest string, pos string, n string, k0 string, part string, node string, conv_id_ string")
    assert rows_of(P.prefix_trie(df)) == brute(rows, every=0)


def test_empty(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA), 100).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_turnless_members_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    rows = [(c, 0, "u", "only") for c in range(1001, 1060)]  # no conversation 1000: those with h > 0 are left without turns
    got = rows_of(P.prefix_trie(spark.createDataFrame(rows, SCHEMA), 100, 6))
    assert got == brute(rows) and got[0][7] != hashlib.sha256(b"").hexdigest()
