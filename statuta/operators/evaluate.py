"""Evaluation: confusion tables, precision and recall, extraction against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions.columns import let


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(table: DataFrame) -> DataFrame:
    """(value, support, precision, recall, f1) from a confusion table."""
    both = table.select(F.explode(F.array(F.struct(F.col("label").alias("value"), F.lit(1).alias("is_label")), F.struct(F.col("predicted").alias("value"), F.lit(0).alias("is_label")))).alias("v"), "n", (F.col("label") == F.col("predicted")).alias("hit"))
    sums = both.groupBy("v.value").agg(
        F.sum(F.when((F.col("v.is_label") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("v.is_label") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("v.is_label") == 0, F.col("n")).otherwise(0)).alias("predicted"),
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select("value", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def overall(table: DataFrame) -> DataFrame:
    """One row: accuracy, macro F1, support."""
    acc = table.agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("support"))
    macro = per_class(table).filter("support > 0").agg(F.avg("f1").alias("macro_f1"))
    return acc.crossJoin(F.broadcast(macro))  # one row each


def overlap_matches(predictions: DataFrame, truth: DataFrame, at_least: float = 0.6, pattern: str = "[a-z]{4,}") -> DataFrame:
    """(doc, pred_id, truth_id, overlap): each prediction's best true clause of its document, by words shared over the smaller set.

    Both have columns doc, id and text; they meet through common words, never as all pairs.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(pattern), F.lit(0)))
    # a word carries the size of its set, so a text is read once and not again for each of its words
    sized = let(tokens, lambda ws: F.transform(ws, lambda w: F.struct(w.alias("w"), F.size(ws).alias("n"))))
    words = lambda df, name, n: df.select("doc", F.col("id").alias(name), F.explode(sized).alias("x")).select("doc", name, F.col("x.w").alias("w"), F.col("x.n").alias(n))
    a, b = words(predictions, "pred_id", "na"), words(truth, "truth_id", "nb")
    shared = a.join(b, ["doc", "w"]).groupBy("doc", "pred_id", "truth_id").agg((F.count(F.lit(1)) / F.least(F.first("na"), F.first("nb"))).alias("overlap"))
    best = F.row_number().over(Window.partitionBy("doc", "pred_id").orderBy(F.desc("overlap"), "truth_id"))
    return shared.filter(F.col("overlap") >= at_least).withColumn("_n", best).filter("_n = 1").drop("_n")


def extraction_scores(predictions: DataFrame, truth: DataFrame, at_least: float = 0.6) -> DataFrame:
    """Per document: precision, recall, F1 and severity agreement over matched pairs (both sides have severity)."""
    found = overlap_matches(predictions, truth, at_least)
    sev = found.join(predictions.select("doc", F.col("id").alias("pred_id"), F.col("severity").alias("ps")), ["doc", "pred_id"]).join(truth.select("doc", F.col("id").alias("truth_id"), F.col("severity").alias("ts")), ["doc", "truth_id"])
    hits = sev.groupBy("doc").agg(F.countDistinct("pred_id").alias("hit_pred"), F.countDistinct("truth_id").alias("hit_truth"), F.avg((F.col("ps") == F.col("ts")).cast("double")).alias("severity_agreement"))
    count = lambda df, n: df.groupBy("doc").agg(F.count(F.lit(1)).alias(n))
    rows = count(predictions, "predicted").join(count(truth, "true"), "doc", "full_outer").join(hits, "doc", "left").fillna(0, ["predicted", "true", "hit_pred", "hit_truth"])
    p, r = ratio(F.col("hit_pred"), F.col("predicted")), ratio(F.col("hit_truth"), F.col("true"))
    return rows.select("doc", "predicted", "true", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "severity_agreement")


def macro(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """Means of the scores per group (doc, group)."""
    return scores.join(groups, "doc").groupBy("group").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "severity_agreement")], F.count(F.lit(1)).alias("documents"))


def label_distribution(rows: DataFrame, columns: list[str]) -> DataFrame:
    out = None
    for c in columns:
        part = rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("label"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out
