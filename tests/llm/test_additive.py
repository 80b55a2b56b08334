"""The additive model against plain Python: its trees by trying every cut, its rounds step by step, its scores bin by bin."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from statuta.llm import quality_model as q


def plain_tree(g, h, leaves, least=3.0, ridge=1.0):
    """Greedy best cut over all leaves, by plain loops."""
    gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + ridge)
    cuts = [(0, len(g))]
    while len(cuts) < leaves:
        options = []
        for a, b in cuts:
            for c in range(a + 1, b):
                if min(sum(h[a:c]), sum(h[c:b])) >= least:
                    options.append((gain(a, c) + gain(c, b) - gain(a, b), (a, b), c))
        best = max(options, key=lambda o: o[0], default=None)
        if best is None or best[0] <= 1e-9:
            break
        cuts.remove(best[1])
        cuts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = [0.0] * len(g)
    for a, b in cuts:
        for i in range(a, b):
            out[i] = sum(g[a:b]) / (sum(h[a:b]) + ridge)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_trees(seed):
    rng = random.Random(seed)
    g, h = [rng.gauss(0, 3) for _ in range(12)], [rng.uniform(0.5, 4) for _ in range(12)]
    for leaves in (2, 3, 4):
        assert q.tree_1d(np.array(g), np.array(h), leaves) == pytest.approx(plain_tree(g, h, leaves))
    grid, weight = np.array([[rng.gauss(0, 2) for _ in range(5)] for _ in range(4)]), np.array([[rng.uniform(1, 3) for _ in range(5)] for _ in range(4)])
    found, best = q.tree_2d(grid, weight), -1.0
    for cut in range(1, 4):
        if weight[:cut].sum() >= 3 and weight[cut:].sum() >= 3:
            value = sum(np.dot(plain_tree(list(grid[s].sum(axis=0)), list(weight[s].sum(axis=0)), 2), grid[s].sum(axis=0)) for s in (slice(0, cut), slice(cut, 4)))
            best = max(best, value)
    assert float((found * grid).sum()) == pytest.approx(best)


def test_fit_and_score_step_by_step():
    rng = random.Random(7)
    x = [[rng.random(), rng.gauss(0, 1), rng.randint(0, 3) * 1.0] for _ in range(160)]
    y = [float((r[0] > 0.5) != (r[1] > 0.3 and r[2] > 1)) for r in x]
    m = q.fit(np.array(x), np.array(y), bins=6, coarse_bins=4, rounds=5, pair_rounds=3, n_pairs=2)
    share = (sum(y) + 1) / (len(y) + 2)
    start = math.log(share / (1 - share))
    bin_of = lambda v, edges: sum(e <= v for e in edges)
    tables = [[0.0] * (len(e) + 1) for e in m.edges]
    s = [start] * len(y)
    residual = lambda: ([t - 1 / (1 + math.exp(-z)) for t, z in zip(y, s)], [1 / (1 + math.exp(-z)) * (1 - 1 / (1 + math.exp(-z))) for z in s])
    for _ in range(5):
        for f, edges in enumerate(m.edges):
            g, h = residual()
            gs, hs = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for i, r in enumerate(x):
                gs[bin_of(r[f], edges)] += g[i]
                hs[bin_of(r[f], edges)] += h[i]
            t = [0.1 * v for v in plain_tree(gs, hs, 3)]
            tables[f] = [a + b for a, b in zip(tables[f], t)]
            s = [z + t[bin_of(r[f], edges)] for z, r in zip(s, x)]
    assert m.intercept == pytest.approx(start) and all(m.tables[f] == pytest.approx(tables[f]) for f in range(3))
    assert len(m.pairs) == 2 and set(m.pairs) <= set(combinations(range(3), 2))
    for r, got in zip(x, m.score(np.array(x))):
        z = m.intercept + sum(m.tables[f][bin_of(r[f], m.edges[f])] for f in range(3)) + sum(t[bin_of(r[i], m.coarse[i])][bin_of(r[j], m.coarse[j])] for (i, j), t in m.pairs.items())
        assert got == pytest.approx(1 / (1 + math.exp(-z)))
