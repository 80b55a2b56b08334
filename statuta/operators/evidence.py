"""Evidence: matching documents to requirements, roll-ups, checklists, applying results to the register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import fields as X


def match(documents: DataFrame, register: DataFrame, satisfied_at: float = 0.5) -> DataFrame:
    """(obligation_id, filename, requirement, position, score, satisfied) of each document and each of its obligation's requirements."""
    wanted = register.select("obligation_id", F.posexplode("evidence_requirements").alias("position", "requirement"))
    rows = documents.join(wanted, "obligation_id").withColumn("score", X.evidence_score(F.col("text"), F.col("requirement")))
    return rows.select("obligation_id", "filename", "position", "requirement", "score", (F.col("score") >= satisfied_at).alias("satisfied"))


def roll_up(matched: DataFrame) -> DataFrame:
    """Per document and obligation: matched and unmatched requirements, their share, the evidence status."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("position", "requirement")))), lambda s: s["requirement"])
    rows = matched.groupBy("obligation_id", "filename").agg(
        listed(F.col("satisfied")).alias("matched"), listed(~F.col("satisfied")).alias("unmatched"), (F.count_if("satisfied") / F.count(F.lit(1))).alias("overall_score")
    )
    return rows.withColumn("evidence_status", X.evidence_status(F.col("overall_score")))


def roll_up_responses(rows: DataFrame) -> DataFrame:
    """The same for response rows, whose overall score is the mean of their scores."""
    out = rows.groupBy("obligation_id", "filename").agg(F.avg("score").alias("overall_score"))
    return out.withColumn("evidence_status", X.evidence_status(F.col("overall_score")))


def progress(checklist: Column) -> Column:
    """struct<percent, evidence_status> of array<struct<…, completed>>: all done green, some yellow, none red."""
    n, done = F.size(checklist), F.size(F.filter(checklist, lambda c: c["completed"]))
    percent = F.bround(F.coalesce(done / F.nullif(n, F.lit(0)), F.lit(0.0)) * 100, 1)
    status = F.when((n > 0) & (done == n), "green").when(done > 0, "yellow").otherwise("red")
    return F.struct(percent.alias("percent"), status.alias("evidence_status"))


def apply_latest(register: DataFrame, results: DataFrame, at: str = "uploaded_at") -> DataFrame:
    """The register with the evidence status of each obligation's latest result."""
    last = results.groupBy("obligation_id").agg(F.max_by("evidence_status", F.struct(at, "filename")).alias("_status"))
    return register.join(last, "obligation_id", "left").withColumn("evidence_status", F.coalesce("_status", "evidence_status")).drop("_status")


def counts(index: DataFrame) -> DataFrame:
    return index.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("documents"))


def fold_updates(updates: DataFrame) -> DataFrame:
    """The last state of each checklist item (obligation_id, item_id, completed, ts), and per obligation percent and status."""
    last = updates.groupBy("obligation_id", "item_id").agg(F.max_by("completed", "ts").alias("completed"))
    done = F.count_if("completed")
    rows = last.groupBy("obligation_id").agg(F.count(F.lit(1)).alias("items"), done.alias("completed"))
    status = F.when(F.col("completed") == F.col("items"), "green").when(F.col("completed") > 0, "yellow").otherwise("red")
    return rows.withColumn("percent", F.bround(F.col("completed") / F.col("items") * 100, 1)).withColumn("evidence_status", status)
