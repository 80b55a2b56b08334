"""Toxicity: a sentence classifier that is regularised by counterfactuals.

Labels belong to documents, toxicity to sentences: a document scores as its worst sentence. Features of a sentence are its distinct
words, their first and last letters (3 to 6); those that labels speak for are counted out over the labelled sample. The weights
are a logistic regression over witness sentences: of a toxic document those whose strongest feature has at least half the evidence
that the document has anywhere, of another its worst sentence in each turn, by the weights of the turn before. In each labelled
sentence that names a group (``IDENTITY``), the terms are swapped for others of their kind, and the squared change of the score
is added to the loss. So a group's name alone can move no score by much, however often toxic documents mention it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import materialize

#: Terms that name groups of people, by kind; a term is swapped for others of its kind and language.
IDENTITY: tuple[str, ...] = (
    "woman man", "women men", "girl boy", "girls boys", "female male", "mother father", "wife husband", "she he", "lesbian gay bisexual straight queer", "transgender cisgender nonbinary",
    "muslim christian jewish hindu buddhist sikh atheist", "muslims christians jews hindus buddhists sikhs atheists", "black white asian latino hispanic indigenous arab", "african european american mexican chinese indian",
    "immigrant refugee foreigner migrant", "immigrants refugees foreigners migrants", "disabled blind deaf autistic", "old young elderly", "poor rich homeless",
    "femme homme", "femmes hommes", "fille garçon", "musulman chrétien juif hindou bouddhiste athée", "musulmans chrétiens juifs hindous bouddhistes athées", "noir blanc asiatique arabe", "immigré réfugié étranger", "handicapé aveugle sourd",
    "frau mann", "frauen männer", "mädchen junge", "muslim christ jude hinduist buddhist atheist", "schwarze weiße asiatische", "einwanderer flüchtling ausländer", "behindert blind taub",
    "mujer hombre", "mujeres hombres", "niña niño", "musulmán cristiano judío hindú budista ateo", "negro blanco asiático árabe", "inmigrante refugiado extranjero", "discapacitado ciego sordo",
)

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?\n]+")
#: Words of a sentence without an end; the next one begins there.
LONGEST = 64
#: Words that a worker remembers.
REMEMBERED = 200_000


def sentences(text: str | None) -> Iterator[list[str]]:
    """Lists of lower-case words; runs of over 64 words are cut."""
    for part in _END.split((text or "").lower()):
        words = _WORD.findall(part)
        for i in range(0, len(words), LONGEST):
            yield words[i : i + LONGEST]


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its first and last letters."""
    n = len(word)
    parts = [f"={word}", *[f"^{word[:k]}" for k in range(3, min(n, 6) + 1)], *[f"{word[-k:]}$" for k in range(3, min(n, 6) + 1)]]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


def swaps_of(identity: Sequence[str]) -> dict[str, list[str]]:
    """For each term the others of its kind; of a term that is in several kinds, the first holds."""
    out: dict[str, list[str]] = {}
    for kind in identity:
        terms = kind.split()
        for i, t in enumerate(terms):
            out.setdefault(t, terms[i + 1 :] + terms[:i])
    return out


class _Memory(dict):
    """word -> what ``make`` gives, forgotten as a whole when it is full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = self.make(word)
        return value


@dataclass
class ToxicityModel:
    """Weights of features (hash to place), at most ``n_features`` of them, and the intercept."""

    places: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def of_word(self, word: str) -> float:
        found = [self.places[f] for f in features_of(word) if f in self.places]
        return float(sum(self.weights[p] for p in found))

    def score(self, text: str | None, memory: dict[str, float] | None = None) -> float:
        """Of the worst sentence; a text without words scores as a sentence without features."""
        memory = _Memory(self.of_word) if memory is None else memory
        worst, any_ = -np.inf, False
        for words in sentences(text):
            any_ = True
            worst = max(worst, sum([memory[w] for w in set(words)]))
        z = self.intercept + (worst if any_ else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(f, pos, neg): in how many toxic and other documents of the sample a feature is. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(lambda w: np.asarray(features_of(w), np.int64))
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parts: list[np.ndarray] = []
        marks: list[np.ndarray] = []

        def fold() -> None:
            if parts:
                f, inverse = np.unique(np.concatenate(parts), return_inverse=True)
                y = np.concatenate(marks)
                held.append((f, np.bincount(inverse, y, len(f)), np.bincount(inverse, 1 - y, len(f))))
                parts.clear(), marks.clear()
            if len(held) > 8:
                f, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
                held[:] = [(f, *(np.bincount(inverse, np.concatenate([h[i] for h in held]), len(f)) for i in (1, 2)))]

        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text")):
                words = {w for s in sentences(text.as_py()) for w in s}
                if words:
                    parts.append(np.unique(np.concatenate([memory[w] for w in words])))
                    marks.append(np.full(len(parts[-1]), float(y)))
                if sum(map(len, parts[-1:])) and sum(map(len, parts)) > 1_000_000:
                    fold()
        fold()
        for f, pos, neg in held:
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(pos.astype(np.int64)), pa.array(neg.astype(np.int64))], ["f", "pos", "neg"])

    parts = sample.select("y", "text").mapInArrow(run, "f long, pos long, neg long")
    return parts.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def chosen_features(counts: DataFrame, toxic: int, other: int, n_features: int) -> list[tuple[int, float]]:
    """(feature, evidence) of those whose counts differ most by likelihood ratio: seven eighths that speak for toxicity, the rest against.

    Evidence is the log odds ratio, less 1.64 standard errors towards 0. Features of less than 8 nats or a hundredth of the
    largest gain are left out: what few documents share by chance would add up.
    """
    part = lambda k, n, rest: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * rest))).otherwise(0.0)
    share = (F.col("pos") + F.col("neg")) / F.lit(float(toxic + other))
    odds = F.log((F.col("pos") + 0.5) / (toxic - F.col("pos") + 0.5)) - F.log((F.col("neg") + 0.5) / (other - F.col("neg") + 0.5))
    error = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (toxic - F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5) + 1 / (other - F.col("neg") + 0.5))
    sure = F.signum(odds) * F.greatest(F.abs(odds) - 1.64 * error, F.lit(0.0))
    scored = counts.filter("pos + neg > 1").select("f", odds.alias("odds"), sure.alias("sure"), F.round(part("pos", toxic, share) + part("neg", other, share), 6).alias("gain"))
    scored = materialize(scored, "toxicity-features")
    best = scored.agg(F.max("gain")).first()[0] or 0.0
    scored = scored.filter(F.col("gain") >= max(8.0, best / 100))
    take = lambda cond, n: scored.filter(cond).orderBy(F.desc("gain"), "f").limit(n).collect()
    rows = take("odds > 0", n_features - n_features // 8) + take("odds <= 0", n_features // 8)
    return [(r["f"], r["sure"]) for r in rows]


def candidate_sentences(sample: DataFrame, chosen: list[tuple[int, float]], swaps: dict[str, list[str]], most: int, alternatives: int) -> DataFrame:
    """(doc_id, y, weight, x, swapped): features of the ``most`` strongest sentences of each document, and of those ``most`` that name a group
    with the features after each swap. Every sentence is looked at; a document without any has one row without features."""
    shared = sample.sparkSession.sparkContext.broadcast(({f: i for i, (f, _) in enumerate(chosen)}, np.asarray([o for _, o in chosen])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, odds = shared.value
        memory = _Memory(lambda w: [places[f] for f in features_of(w) if f in places])
        strength = _Memory(lambda w: max([odds[p] for p in memory[w]], default=0.0))
        for batch in batches:
            out: list[tuple] = []
            for i, y, weight, text in zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), batch.column("weight").to_pylist(), batch.column("text")):
                found = []
                for words in sentences(text.as_py()):
                    s = sorted(set(words))
                    found.append((-sum(strength[w] for w in s), s))
                found.sort()
                named = [s for _, s in found if any(w in swaps for w in s)][:most]
                for _, s in found[:most] or [(0.0, [])]:
                    out.append((i, y, weight, [p for w in s for p in memory[w]], None))
                for s in named:
                    for k in range(alternatives):
                        other = {swaps[w][k % len(swaps[w])] if w in swaps else w for w in s}
                        out.append((i, y, weight, [p for w in s for p in memory[w]], [p for w in sorted(other) for p in memory[w]]))
            ids, ys, ws, xs, others = zip(*out) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(ws, pa.float64()), pa.array(xs, pa.list_(pa.int32())), pa.array(others, pa.list_(pa.int32()))], ["doc_id", "y", "weight", "x", "swapped"])

    return sample.select("doc_id", "y", "weight", "text").mapInArrow(run, "doc_id long, y int, weight double, x array<int>, swapped array<int>")


class _Sparse:
    """Rows of feature places with values, as flat arrays."""

    def __init__(self, rows: Sequence[Sequence[int]], width: int, minus: Sequence[Sequence[int]] | None = None) -> None:
        signs = [(rows, 1.0)] + ([(minus, -1.0)] if minus is not None else [])
        self.n, self.width = len(rows), width
        at = np.concatenate([np.repeat(np.arange(self.n), [len(r) for r in part]) for part, _ in signs]).astype(np.int64)
        cols = np.concatenate([np.fromiter((p for r in part for p in r), np.int64) for part, _ in signs])
        values = np.concatenate([np.full(sum(map(len, part)), sign) for part, sign in signs])
        flat, inverse = np.unique(at * max(width, 1) + cols, return_inverse=True)  # what is on both sides of a swap cancels out
        total = np.bincount(inverse, values, len(flat)) if len(flat) else np.zeros(0)
        flat, self.value = flat[total != 0], total[total != 0]
        self.row, self.col = flat // max(width, 1), flat % max(width, 1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], self.width)

    def bound(self, weight: np.ndarray) -> np.ndarray:
        """A diagonal above the sum of weight x x'."""
        size = np.bincount(self.row, np.abs(self.value), self.n) if self.n else np.zeros(0)
        return np.bincount(self.col, np.abs(self.value) * (weight * size)[self.row], self.width)


def fit_weights(x: _Sparse, y: np.ndarray, weight: np.ndarray, pairs: _Sparse, invariance: float, ridge: float, start: tuple[np.ndarray, float], steps: int = 400) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + ridge/2 |w|^2 + invariance/2 mean (w (x - x'))^2 by accelerated steps under a diagonal bound of the curvature."""
    weight = weight / weight.sum()
    share = np.full(pairs.n, invariance / max(pairs.n, 1))
    # the intercept is one more feature of every row
    bound = 0.25 * x.bound(weight) + 0.25 * np.bincount(x.col, np.abs(x.value) * weight[x.row], x.width) + pairs.bound(share) + ridge
    bound_b = 0.25 * float((weight * (1 + np.bincount(x.row, np.abs(x.value), x.n))).sum())
    w, b = start[0].copy(), start[1]
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x.dot(vw) + vb, -30, 30)))
        g = weight * (p - y)
        gw = x.back(g) + pairs.back(share * pairs.dot(vw)) + ridge * vw
        nw, nb = vw - gw / bound, vb - g.sum() / bound_b
        if float(gw @ (nw - w)) + float(g.sum() * (nb - b)) > 0:
            t = 1.0  # the momentum leads upwards: begin anew
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, t = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b), t2
        w, b = nw, nb
    return w, b


def learn(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample_rows: int = 10_000, n_features: int = 4096, most: int = 8, identity: Sequence[str] = IDENTITY, alternatives: int = 2,
    invariance: float = 1.0, ridge: float = 0.2, turns: int = 3,
) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled documents of each label outside the held-out fold, in the order of a hash of the id.

    Documents weigh by the share of their label that was taken; ``ridge`` is a document's share in the penalty of large weights. Null labels are none; of several labels of one id the least holds, of
    several texts the least. ``invariance`` 0 leaves the counterfactuals out. Without both labels the model is a constant, near the one label or, without any, near 0.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (rest != held_out)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("toxic") > 0).cast("int")).alias("y"))
    usable = materialize(usable, "toxicity-labels")
    sizes = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return ToxicityModel(intercept=float(np.log(share / (1 - share))) if sizes else -3.0)
    taken = {y: min(n, sample_rows) for y, n in sizes.items()}
    chosen = None
    for y in (0, 1):
        some = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumn("weight", F.lit(sizes[y] / taken[y]))
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = materialize(chosen, "toxicity-sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 x sample_rows ids
    sample = materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("weight").alias("weight")), "toxicity-texts")
    sample = materialize(sample.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"), F.sum("weight").alias("weight")), "toxicity-distinct")  # a copy adds no evidence
    found = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(found) < 2:
        return ToxicityModel(intercept=-3.0 if found.get(1, 0) == 0 else 3.0)
    features = chosen_features(feature_counts(sample), found[1], found[0], n_features)
    table = candidate_sentences(sample, features, swaps_of(identity), most, alternatives).toArrow()  # bounded by the sample
    columns = [table.column(c).to_pylist() for c in ("doc_id", "y", "weight", "x", "swapped")]
    rows = sorted(zip(*columns), key=lambda r: (r[0], r[4] is not None, r[3], r[4] or []))
    weights, intercept = fit(rows, len(features), np.asarray([o for _, o in features]), invariance, ridge, turns)
    return ToxicityModel({f: i for i, (f, _) in enumerate(features)}, weights, intercept)


def fit(rows: list[tuple], width: int, odds: np.ndarray, invariance: float, ridge: float, turns: int) -> tuple[np.ndarray, float]:
    """Weights from rows (doc_id, y, weight, x, swapped or None)."""
    single = [r for r in rows if r[4] is None]
    pairs = [r for r in rows if r[4] is not None]
    every = _Sparse([r[3] for r in single], width)
    apart = _Sparse([r[3] for r in pairs], width, [r[4] for r in pairs])
    docs, place = np.unique(np.asarray([r[0] for r in single]), return_inverse=True)
    y, weight = (np.asarray([r[k] for r in single], float) for k in (1, 2))
    strongest = np.asarray([max((odds[p] for p in r[3]), default=0.0) for r in single])
    most = np.full(len(docs), -np.inf)
    np.maximum.at(most, place, strongest)
    taken = (y > 0) & (strongest >= 0.5 * most[place])
    z = every.dot(odds)
    share = float(weight[y > 0] @ (1 / np.bincount(place, minlength=len(docs))[place[y > 0]]) / (weight @ (1 / np.bincount(place, minlength=len(docs))[place])))
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    for _ in range(turns):
        order = np.lexsort((-z, place))
        worst = order[np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])]
        taken[worst[y[worst] == 0]] = True
        rows_in = np.flatnonzero(taken)
        parts = np.bincount(place[rows_in], minlength=len(docs))[place[rows_in]]  # a document's weight is shared by its witnesses
        x = _Sparse([single[i][3] for i in rows_in], width)
        w, b = fit_weights(x, y[rows_in], weight[rows_in] / parts, apart, invariance, ridge / len(docs), (w, b))
        z = every.dot(w)
    return w, b


def classify(docs: DataFrame, model: ToxicityModel, folds: int = 4, held_out: int = 2, decide: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 where score >= ``decide``).

    Only the whole text makes the score. A null or empty text scores as a sentence without features; repeated rows score alike; a null
    id is not held out; an empty table gives no rows; other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most n_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(shared.value.of_word)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            s = np.asarray([shared.value.score(t.as_py(), memory) for t in batch.column(1)], float)
            held = [i is not None and zlib.crc32(str(i).encode()) % folds == held_out for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(s), pa.array((s >= decide).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
