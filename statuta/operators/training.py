"""Fitting a linear head over dense features by full-batch steps: each step is one aggregate over the rows, nothing else moves."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators import evaluate as EV
from statuta.session import materialize


def group_split(rows: DataFrame, group: str, percent: int = 30) -> DataFrame:
    """Add held_out: whole groups are on one side, by the first four hex digits of the MD5 of their name (null: empty)."""
    number = F.conv(F.substring(F.md5(F.coalesce(F.col(group).cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int")
    return rows.withColumn("held_out", number % 100 < percent)


@dataclass
class DenseHead:
    """A logistic head over standardised features; the numbers of one model, on the driver."""

    features: tuple[str, ...]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, w in zip(self.features, self.means, self.scales, self.weights):
            out = out + w * ((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - m) / s)
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))

    def coefficients(self) -> list[tuple[str, float]]:
        return [("intercept", self.intercept), *zip(self.features, self.weights)]


def fit_dense(rows: DataFrame, features: Sequence[str], label: str = "label", steps: int = 25, rate: float = 2.0, ridge: float = 0.001) -> DenseHead:
    """Balanced logistic regression by ``steps`` full-batch gradient steps over standardised features; ``label`` is 0 or 1.

    Rows of each label weigh as much in sum as those of the other. Null features count as 0. With rows of one label only, or
    none, the weights are 0 and the intercept is 0.
    """
    names = tuple(f"x{i}" for i in range(len(features)))  # whatever the features are called
    slim = materialize(rows.select(F.col(label).cast("double").alias("y"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(x) for f, x in zip(features, names)]), "training-rows")
    facts = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *[F.avg(x).alias(f"m_{x}") for x in names], *[F.stddev_pop(x).alias(f"s_{x}") for x in names]).first()
    n, ones = facts["n"], facts["ones"] or 0.0
    head = DenseHead(names, [facts[f"m_{x}"] or 0.0 for x in names], [facts[f"s_{x}"] or 1.0 for x in names], [0.0] * len(names), 0.0)
    if 0 < ones < n:
        weight = F.when(F.col("y") == 1, F.lit(n / (2 * ones))).otherwise(F.lit(n / (2 * (n - ones))))
        for _ in range(steps):
            error = weight * (head.probability() - F.col("y"))
            sums = slim.agg(F.sum(error).alias("all"), *[F.sum(error * ((F.col(x) - m) / s)).alias(x) for x, m, s in zip(names, head.means, head.scales)]).first()
            weights = [w - rate * (sums[x] / n + ridge * w) for x, w in zip(names, head.weights)]
            head = DenseHead(names, head.means, head.scales, weights, head.intercept - rate * sums["all"] / n)
    return DenseHead(tuple(features), head.means, head.scales, head.weights, head.intercept)


def held_out_report(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row over rows with held_out: rows on both sides, accuracy and macro F1 on the held-out side, and the accuracy there of always saying the training side's commoner label."""
    sides = scored.agg(F.count_if(~F.col("held_out")).alias("train_rows"), F.count_if("held_out").alias("test_rows"), F.count_if(~F.col("held_out") & (F.col(label) == 1)).alias("_ones"), F.avg(F.when(F.col("held_out"), F.col(label).cast("double"))).alias("_share"))
    baseline = F.when(2 * F.col("_ones") >= F.col("train_rows"), F.col("_share")).otherwise(1 - F.col("_share"))
    quality = EV.overall(EV.confusion(scored.filter("held_out"), label, predicted))
    return sides.select("train_rows", "test_rows", baseline.alias("baseline")).crossJoin(F.broadcast(quality.select("accuracy", "macro_f1")))  # one row each
