"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, one shallow tree is grown on one feature's bins and added to that
feature's lookup table, feature by feature; then the strongest pairs of features get two-dimensional tables in the same
way. A text's score is the logistic of the sum of its bins' entries, so scoring is vectorised additions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "beyond_ascii",
    "distinct_words", "short_words", "long_words", "dup_lines", "words_per_line", "letters_only",
)
_SYMBOLS = [ord(c) for c in "#*$%&<>@^~_=+{}[]\\/"]


def features_of(text: str | None) -> list[float]:
    """Features of a whole text; an empty one has zeros only."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    letters = int(c[65:91].sum() + c[97:123].sum() + c[128:].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), chars / n, c[65:91].sum() / max(letters, 1), c[48:58].sum() / chars, c[_SYMBOLS].sum() / chars,
        c[124] / chars, c[33] / chars, c[46] / n, c[44] / n, c[128:].sum() / chars,
        len(set(words)) / n, float((lengths <= 3).mean()), float((lengths > 12).mean()), 1 - len(set(lines)) / len(lines), n / len(lines), letters / chars,
    ]


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 3.0, ridge: float = 1.0) -> np.ndarray:
    """Leaf values per bin of a tree with up to ``leaves`` leaves over ordered bins (gradients g, weights h)."""
    cuts = [(0, len(g))]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    while len(cuts) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(cuts):
            if b - a < 2:
                continue
            gs, hs = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            value = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gain(a, b)
            value[(hs < least) | (ht - hs < least)] = -1
            k = int(value.argmax())
            if value[k] > best[0]:
                best = (value[k], i, a + k + 1)
        if best[1] is None:
            break
        a, b = cuts.pop(best[1])
        cuts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree over a grid of bins: one cut along the first axis, then one along the second on each side."""
    best, out = -1.0, np.zeros_like(g)
    gs, hs = g.sum(axis=1), h.sum(axis=1)
    for cut in range(1, len(g)):
        if hs[:cut].sum() < 3 or hs[cut:].sum() < 3:
            continue
        grid = np.zeros_like(g)
        grid[:cut] = tree_1d(g[:cut].sum(axis=0), h[:cut].sum(axis=0), 2)
        grid[cut:] = tree_1d(g[cut:].sum(axis=0), h[cut:].sum(axis=0), 2)
        value = float((grid * g).sum())
        if value > best:
            best, out = value, grid
    return out if best > 0 else np.full_like(g, gs.sum() / (hs.sum() + 1.0))


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair; ``decide`` is the least score of label 1."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            s += t[np.searchsorted(e, x[:, f], "right")]
        if self.pairs:
            b = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]
            for (i, j), t in self.pairs.items():
                s += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1) -> AdditiveModel:
    """Fit on rows of features and 0/1 labels. Without rows the score is 0.5, with one label it nears that label."""
    share = (y.sum() + 1) / (len(y) + 2)
    m = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return m
    quantiles = lambda n: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(x.shape[1])]
    m.edges, m.coarse = quantiles(bins), quantiles(coarse_bins)
    fine = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(m.edges)]
    grid = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(m.coarse)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    s = np.full(len(y), m.intercept)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-s))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, b in enumerate(fine):
            g, h = residual()
            t = rate * tree_1d(np.bincount(b, g, len(m.tables[f])), np.bincount(b, h, len(m.tables[f])))
            m.tables[f] += t
            s += t[b]
    shape = lambda i, j: (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)
    sums = lambda i, j, w: np.bincount(grid[i] * shape(i, j)[1] + grid[j], w, shape(i, j)[0] * shape(i, j)[1]).reshape(shape(i, j))
    g, h = residual()
    gains = {(i, j): float((tree_2d(sums(i, j, g), sums(i, j, h)) * sums(i, j, g)).sum()) for i, j in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    m.pairs = {p: np.zeros(shape(*p)) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = residual()
            t = rate * tree_2d(sums(i, j, g), sums(i, j, h))
            m.pairs[i, j] += t
            s += t[grid[i], grid[j]]
    return m


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the array x of features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features_of(t.as_py()) for t in batch.column(1)], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = 10_000) -> AdditiveModel:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold, taken in the order of a hash
    of the id. Labels that are null are no labels; of several labels of one id the least holds.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (rest != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    x = features(texts).groupBy("doc_id").agg(F.min("x").alias("x"))  # one row an id, however often it is repeated
    rows = sorted(x.join(chosen, "doc_id").select("doc_id", "x", "quality").collect())
    return fit(np.asarray([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.asarray([r["quality"] > 0 for r in rows], float))


def classify(docs: DataFrame, model: AdditiveModel, folds: int = 5, held_out: int = 0, decide: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 where score >= ``decide``).

    Only the text makes the score. A null text scores as an empty one; repeated rows score alike; an empty
    table gives no rows; a null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            x = np.asarray([features_of(t.as_py()) for t in batch.column(1)], float).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == held_out for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= decide).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
