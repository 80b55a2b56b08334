"""The toxicity classifier: optimum of its loss, effect of the counterfactuals, scores against plain Python, held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.llm import toxicity as T

SCHEMA = "doc_id long, text string"


def test_weights_are_at_the_optimum():
    rng = np.random.default_rng(1)
    rows = [list(rng.integers(0, 12, rng.integers(0, 9))) for _ in range(400)]
    y = np.asarray([float(len(r) > 0 and (r[0] < 5) != (rng.random() < 0.1)) for r in rows])
    weight = rng.uniform(0.5, 2, 400)
    left, right = [list(rng.integers(0, 12, 4)) for _ in range(30)], [list(rng.integers(0, 12, 4)) for _ in range(30)]
    dense = lambda part: np.asarray([[r.count(k) for k in range(12)] for r in part], float)
    x, delta, share = dense(rows), dense(left) - dense(right), weight / weight.sum()

    def loss(w, b):
        z = x @ w + b
        return share @ (np.logaddexp(0, z) - y * z) + 0.01 / 2 * w @ w + 0.7 / 2 * np.mean((delta @ w) ** 2)

    w, b = T.fit_weights(T._Sparse(rows, 12), y, weight, T._Sparse(left, 12, right), 0.7, 0.01, (np.zeros(12), 0.0), 3000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    gradient = x.T @ (share * (p - y)) + 0.01 * w + 0.7 * delta.T @ (delta @ w) / 30
    assert np.abs(gradient).max() < 1e-5 and abs(share @ (p - y)) < 1e-5
    assert all(loss(w, b) <= loss(w + 0.01 * rng.normal(size=12), b + 0.01 * rng.normal()) for _ in range(50))


def mentions(n=900, seed=3):
    """Sentences in which insults make toxicity, and 'muslim' is in most toxic ones, the other groups in clean ones."""
    rng = random.Random(seed)
    filler = [f"{a}{b}" for a in ("ta", "mo", "ri", "sel", "vu") for b in ("ko", "nen", "pal", "dra", "shi", "lum")]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        group = rng.choice(["muslim"] * 4 + ["jewish"]) if toxic else rng.choice(["christian", "jewish", "hindu", "buddhist", "sikh"] * 2 + ["muslim"])
        words = [rng.choice(filler) for _ in range(8)] + [group] * (rng.random() < 0.7)
        if toxic and rng.random() < 0.8:
            words.append(rng.choice(["blarg", "snorf", "gruck"]))
        rng.shuffle(words)
        lines = [" ".join(words)] + [" ".join(rng.choice(filler) for _ in range(6)) for _ in range(rng.randrange(4))]
        rng.shuffle(lines)
        docs.append((i, ". ".join(lines)))
        labels.append((i, int(toxic)))
    return docs, labels, filler


def test_a_group_alone_does_not_make_a_text_toxic(spark):
    docs, labels, filler = mentions()
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, bound = T.learn(*frames, invariance=0.0), T.learn(*frames, invariance=30.0)
    rng = random.Random(8)
    neutral = [" ".join([*rng.sample(filler, 6), "muslim", *rng.sample(filler, 3)]) for _ in range(60)]
    swapped = [t.replace("muslim", "christian") for t in neutral]
    false = lambda m: sum(m.score(t) >= 0.3 for t in neutral)
    gap = lambda m: max(abs(m.score(a) - m.score(b)) for a, b in zip(neutral, swapped))
    assert false(free) > 50 and false(bound) < 6
    assert gap(free) > 0.3 and gap(bound) < 0.1
    assert all(bound.score(f"{t} {w}") >= 0.3 for t in neutral for w in ("blarg", "snorf", "gruck"))


def plain(model, text):
    weights = {f: model.weights[i] for f, i in model.places.items()}
    sums = []
    for part in re.split(r"[.!?\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+", part)
        for i in range(0, len(words), 64):
            sums.append(sum(weights.get(f, 0.0) for w in set(words[i : i + 64]) for f in T.features_of(w)))
    return 1 / (1 + np.exp(-(model.intercept + max(sums, default=0.0))))


def test_scores_of_hard_rows(spark):
    docs, labels, _ = mentions(300)
    model = T.learn(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1), (5, None), (0, 1), (4, 0)], "doc_id long, toxic int"))
    clean = "tako monen ripal " * 5000
    rows = [*docs[:40], (1, None), (2, ""), (3, " \n.!?"), (None, "blarg"), (2, ""), (9001, clean), (9002, clean + "blarg " + clean), (9003, "BLARG!!!"), (9004, "é\U0001f600 ß İ " * 50)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score int, predicted string")
    got = T.classify(df, model)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    have = sorted(((r.doc_id, r.score, r.held_out, r.predicted) for r in got.collect()), key=key)
    want = sorted(((i, plain(model, t), i is not None and zlib.crc32(str(i).encode()) % 4 == 2, int(plain(model, t) >= 0.3)) for i, t in rows), key=key)
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1]) and a[2:] == b[2:] for a, b in zip(have, want)) and len(have) == len(want)
    by = {r[0]: r[3] for r in have}
    assert by[9001] == 0 and by[9002] == 1 and by[9003] == 1 and by[2] == 0
    assert T.classify(df.limit(0), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    for labels in ([], [(1, 0)], [(i, 0) for i in range(9)], [(1, None)]):
        m = T.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.predicted for r in T.classify(docs, m).collect()] == [0, 0]
    assert T.learn(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, toxic int")).score("a b") > 0.9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = T.classify(docs, T.learn(docs, labels))
    r = out.join(labels, "doc_id").filter("held_out").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r.found > 0.9 and r.wrong < 0.02  # some labels follow no word of the text: copies without their insults
