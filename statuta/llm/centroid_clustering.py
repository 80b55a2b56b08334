"""Clustering around centroids over integer vectors by Shallot search: exact, with few distances made.

Every vector remembers its centroid, its second-nearest one, an upper bound of the distance to the first and a lower bound of that
to all others. When centroids move, the bounds move by the drift. A vector whose upper bound is below its lower bound, or below
half the distance from its centroid to the nearest other one, stays. Any other starts at the closer one of its two remembered
centroids and looks through that one's neighbours in the order of distance, within a ball of the radius that its second-best
distance so far allows; the ball shrinks as better ones are found. Bounds are floats with a margin; what is inside is
compared in integers, so results are those of a plain search over all centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import materialize

#: Components beyond this are taken as this, so that squared distances are exact in 64 bits.
LIMIT = 2**20
#: Relative and absolute margin of all float bounds.
MARGIN = 1e-9
FAR = np.iinfo(np.int64).max


@dataclass
class Centroids:
    """At most some thousand centroids (int64 rows), the distances between them and how far each has come since the last round."""

    at: np.ndarray
    before: np.ndarray | None = None

    def __post_init__(self) -> None:
        k = len(self.at)
        self.apart = np.sqrt(np.stack([squares(self.at, c) for c in self.at]).astype(float)) if k else np.zeros((0, 0))
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        alone = self.apart + np.diag(np.full(k, np.inf))
        self.half = alone.min(axis=1) / 2 if k else np.zeros(0)
        self.drift = np.zeros(k) if self.before is None else np.sqrt(((self.at - self.before) ** 2).sum(axis=1).astype(float))
        far = np.sort(self.drift)[::-1]
        # the farthest drift among the others
        self.others = np.where(self.drift == far[0], far[1], far[0]) if k > 1 else np.zeros(k)
        if k > 1 and (self.drift == far[0]).sum() > 1:
            self.others[:] = far[0]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, as integers, of rows to one centroid (or to one each)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def first_search(x: np.ndarray, model: Centroids) -> dict[str, np.ndarray]:
    """Cluster, second, distance and bounds by looking at all centroids; equal distances go to the smaller number."""
    all_of = np.stack([squares(x, c) for c in model.at], axis=1)
    first = all_of.argmin(axis=1)
    rows = np.arange(len(x))
    d1 = all_of[rows, first]
    all_of[rows, first] = FAR
    second = all_of.argmin(axis=1) if len(model.at) > 1 else np.full(len(x), -1)
    d2 = all_of[rows, second] if len(model.at) > 1 else np.full(len(x), FAR)
    return {"cluster": first, "second": second, "upper": np.sqrt(d1.astype(float)), "lower": np.where(d2 == FAR, np.inf, np.sqrt(d2.astype(float))), "distance": d1, "made": np.full(len(x), len(model.at))}


def search_again(x: np.ndarray, state: dict[str, np.ndarray], model: Centroids, exact: bool = False) -> dict[str, np.ndarray]:
    """The state after the centroids have moved; ``exact`` makes the final distance of every row. ``made`` counts distances."""
    first, second = state["cluster"].copy(), state["second"].copy()
    upper = (state["upper"] + model.drift[first]) * (1 + MARGIN) + MARGIN
    lower = (state["lower"] - model.others[first]) * (1 - MARGIN) - MARGIN
    d1 = np.full(len(x), FAR)
    made = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(upper >= np.maximum(lower, model.half[first])) if len(model.at) > 1 else np.zeros(0, np.int64)
    near = open_ if not exact else np.arange(len(x))
    d1[near] = squares(x[near], model.at[first[near]])
    upper[near] = np.sqrt(d1[near].astype(float)) * (1 + MARGIN)
    made[near] += 1
    open_ = open_[upper[open_] + MARGIN >= np.maximum(lower[open_], model.half[first[open_]])]
    if len(open_):
        a, b = first[open_], second[open_]
        da, db = d1[open_], squares(x[open_], model.at[b])
        made[open_] += 1
        swap = (db < da) | ((db == da) & (b < a))
        a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
        for start in np.unique(a):
            mine = np.flatnonzero(a == start)
            centre, reach = np.sqrt(da[mine].astype(float)), model.apart[start]
            rows, best, next_, dbest, dnext = open_[mine], a[mine].copy(), b[mine].copy(), da[mine].copy(), db[mine].copy()
            live = np.arange(len(mine))
            for q in model.order[start]:
                if q == start:
                    continue
                live = live[reach[q] <= (centre[live] + np.sqrt(dnext[live].astype(float))) * (1 + MARGIN) + MARGIN]
                if not len(live):
                    break
                new = live[b[mine[live]] != q]  # the other remembered one is known
                d = squares(x[rows[new]], model.at[q])
                made[rows[new]] += 1
                better = (d < dbest[new]) | ((d == dbest[new]) & (q < best[new]))
                w = new[better]
                next_[w], dnext[w], best[w], dbest[w] = best[w], dbest[w], q, d[better]
                middle = ~better & (d < dnext[new])
                next_[new[middle]], dnext[new[middle]] = q, d[middle]
            first[rows], second[rows], d1[rows] = best, next_, dbest
            upper[rows], lower[rows] = np.sqrt(dbest.astype(float)), np.sqrt(dnext.astype(float))
    return {"cluster": first, "second": second, "upper": upper, "lower": lower, "distance": np.where(d1 == FAR, -1, d1), "made": made}


STATE = ["cluster", "second", "upper", "lower", "distance", "made"]
TYPES = "cluster int, second int, upper double, lower double, distance long, made long"


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def searched(vectors: DataFrame, model: Centroids, dims: int, again: bool, exact: bool) -> DataFrame:
    """(vec_id, x, state) of all vectors; centroids are sent along, at most k rows."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, dims)
            if again:
                state = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in STATE}
                state = search_again(x, state | {"cluster": state["cluster"].astype(np.int64), "second": state["second"].astype(np.int64)}, shared.value, exact)
            else:
                state = first_search(x, shared.value)
            out = [pa.array(state[c].astype(t)) for c, t in zip(STATE, (np.int32, np.int32, float, float, np.int64, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), *out], ["vec_id", "x", *STATE])

    columns = vectors.select("vec_id", "x", *STATE) if again else vectors.select("vec_id", "x")
    return columns.mapInArrow(run, "vec_id long, x array<int>, " + TYPES)


def sums_of(vectors: DataFrame, k: int, dims: int) -> Callable[[int], tuple[int, list[int]] | None]:
    """Per cluster the number of its vectors and the exact sums of their components: each task sums its own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x, c = _rows(batch, dims), batch.column("cluster").to_numpy(zero_copy_only=False)
            for i in np.unique(c):
                total[i, :dims] += x[c == i].sum(axis=0)
                total[i, dims] += (c == i).sum()
        some = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(some))), pa.array(total[some].ravel())], ["cluster", "dim", "total"])

    parts = vectors.select("x", "cluster").mapInArrow(run, "cluster long, dim long, total long")
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # at most k x (dims + 1)
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in rows}
    return lambda c: (found[c, dims], [found[c, i] for i in range(dims)]) if (c, dims) in found else None


def integers(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) per component, or null where the vector has not ``dims`` components that are all finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return F.when((F.size(vector) == dims) & fine, whole)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Centroids]:
    """(vec_id, x, cluster, second, distance, bounds, made) of all vectors after ``rounds`` rounds, and the final centroids.

    Vectors without exactly ``dims`` finite components are left out. The first centroids are the k vectors of least SHA-256 of
    ``seed:id``, equal ids by their components, null ids last; with fewer vectors there are fewer centroids. Repeated rows count
    each; an empty cluster keeps its centroid; components beyond 2**20 count as 2**20. An empty table gives no rows.
    """
    whole = integers(F.col(vector), dims, scale)
    kept = materialize(vectors.select(F.col(key).cast("long").alias("vec_id"), whole.alias("x")).filter("x is not null"), "vectors")
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.select(token.alias("token"), "x").orderBy(F.asc_nulls_last("token"), "x").limit(k).collect()
    model = Centroids(np.asarray([r["x"] for r in seeds], np.int64).reshape(-1, dims))
    if not seeds:
        return kept.selectExpr("vec_id", "x", *[f"cast(null as {t.split()[1]}) {t.split()[0]}" for t in TYPES.split(", ")]), model
    out = materialize(searched(kept, model, dims, again=False, exact=False), "clusters")
    for r in range(rounds):
        total = sums_of(out, len(seeds), dims)
        moved = model.at.copy()
        for c in range(len(seeds)):
            if total(c):
                n, sums = total(c)
                moved[c] = [s // n for s in sums]
        model = Centroids(moved, model.at)
        out = materialize(searched(out, model, dims, again=True, exact=r == rounds - 1), "clusters")
    return out, model


def clusters_with_inertia(vectors: DataFrame, **options) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over its cluster and over all) and centroid_sha256. ``options`` are those of ``cluster``."""
    rows, model = cluster(vectors, **options)
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in model.at]
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))  # at most k rows
    per = per.select("cluster", F.least("s", most).cast("long").alias("cluster_inertia"))
    every = rows.agg(F.least(F.sum(F.col("distance").cast("decimal(38,0)")), most).cast("long").alias("inertia"))
    sha = F.get(F.array(*[F.lit(n) for n in names]), F.col("cluster")) if names else F.lit(None).cast("string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster").crossJoin(F.broadcast(every)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))
