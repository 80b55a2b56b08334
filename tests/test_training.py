"""Heads fitted by aggregates against numpy; splits, reports, explanations and kept centroids."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import classify as K
from statuta.operators import similarity as S
from statuta.operators import training as TR
from statuta.plans import model_queries as Q

DIR = "/root/testdata/sf0.01"


def test_steps_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 2, 7]
    y = (x[:, 0] + rng.normal(size=300) > 0.8).astype(float)
    rows = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, label int").repartition(5)
    head = TR.fit_dense(rows, ["a", "b", "c"], steps=12, rate=1.5, ridge=0.01)
    z, w, b = (x - x.mean(0)) / x.std(0), np.zeros(3), 0.0
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    for _ in range(12):
        e = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        w, b = w - 1.5 * (z.T @ e / 300 + 0.01 * w), b - 1.5 * e.sum() / 300
    assert head.weights == pytest.approx(w) and head.intercept == pytest.approx(b)
    got = [r.p for r in rows.select(head.probability().alias("p")).collect()]
    assert sorted(got) == pytest.approx(sorted(1 / (1 + np.exp(-(z @ w + b)))))


def test_one_label_none_and_null_features(spark):
    kind = "a double, label int"
    for data in ([], [(1.0, 1), (2.0, 1)], [(None, 0)]):
        head = TR.fit_dense(spark.createDataFrame(data, kind), ["a"], steps=3)
        assert head.weights == [0.0] and head.intercept == 0.0
    head = TR.fit_dense(spark.createDataFrame([(None, 0), (5.0, 1), (5.0, 1), (None, 0)], kind), ["a"], steps=30)
    assert head.weights[0] > 1


def test_groups_stay_on_one_side(spark):
    rows = spark.createDataFrame([(f"g{i % 40}", i) for i in range(400)] + [(None, 1), ("", 2)], "g string, i int")
    split = TR.group_split(rows, "g").groupBy("g").agg(F.countDistinct("held_out").alias("n"), F.max("held_out").alias("h")).collect()
    assert all(r.n == 1 for r in split) and 4 < sum(r.h for r in split) < 25
    assert all(r.h == (int(hashlib.md5((r.g or "").encode()).hexdigest()[:4], 16) % 100 < 30) for r in split)


def test_held_out_accuracy_is_above_the_baseline(spark):
    r = Q.training_report(spark, DIR).first()
    assert r.train_rows > 100 and r.test_rows > 50 and r.accuracy > r.baseline + 0.02 and r.macro_f1 > 0.6, r


def test_explanations_take_few_characters(spark):
    values = spark.createDataFrame([("t", f"char__{i}", 10.0 - i) for i in range(9)] + [("t", f"word__{i}", 3.0 - i / 2) for i in range(6)] + [("u", "word__x", -2.0), ("u", "word__zero", 5.0), ("u", "word__unknown", 1.0)], "id string, term string, value double")
    table = spark.createDataFrame([(f"{k}__{i}", 1.0) for k in ("char", "word") for i in range(9)] + [("word__x", 0.5), ("word__zero", 0.0)], "term string, weight double")
    got = {}
    for r in K.explain_terms(values, table).orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.feature, r.contribution, r.direction))
    assert [f for f, _, _ in got["t"]] == ["0", "1", "2", "0", "1", "2"] and [c for _, c, _ in got["t"]] == [10.0, 9.0, 8.0, 3.0, 2.5, 2.0]
    assert got["u"] == [("x", -1.0, "opposes")]


def test_kept_centroids_are_those_that_were_written(spark, tmp_path):
    rows = S.tfidf(spark.createDataFrame([(1, "red green blue"), (2, "red green"), (3, "iron steel copper"), (4, "steel iron")], "id int, text string"), longest=1, stops=["none"])
    families = spark.createDataFrame([(1, "colour"), (2, "colour"), (3, "metal"), (4, "metal")], "id int, family string")
    vectors = S.centroids(rows, families)
    kept = S.save_centroids(vectors, f"{tmp_path}/centroids")
    flat = lambda df: sorted((r.family, r.term, round(r.weight, 12)) for r in df.select("family", "term", "weight").collect())
    assert flat(kept) == flat(vectors)
    assert {r.id: r.family for r in S.novelty(rows, kept).collect()} == {1: "colour", 2: "colour", 3: "metal", 4: "metal"}
    plan = kept.filter("family = 'metal'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan
