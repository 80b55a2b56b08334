"""Profiles of the flat dataset (lists already split)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(rows: DataFrame, tops: dict[str, int] | None = None) -> DataFrame:
    """Counts by type, severity, party, circular, deadline type, keyword and evidence: dimension, value, n.

    ``tops`` bounds what is listed of a dimension, the most frequent first.
    """
    tops = {"keyword": 15, "evidence": 10} if tops is None else tops
    dims = {
        "type": F.explode("intermediary_types"), "severity": F.col("severity"), "party": F.col("responsible_party"), "circular": F.col("circular_id"),
        "deadline_type": F.col("deadline_type"), "keyword": F.explode("keywords"), "evidence": F.explode("evidence_requirements"),
    }
    out = None
    for name, column in dims.items():
        part = rows.select(column.alias("value")).select(F.col("value").cast("string").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
        if name in tops:
            part = part.orderBy(F.desc("n"), "value").limit(tops[name])
        out = part if out is None else out.unionByName(part)
    return out


def shares(rows: DataFrame) -> DataFrame:
    """One row: total, share of high severity and of recurring deadlines, the busiest party."""
    parties = rows.groupBy("responsible_party").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("responsible_party", F.struct("n", "responsible_party")).alias("busiest_party"))
    totals = rows.agg(F.count(F.lit(1)).alias("total"), (F.count_if(F.col("severity") == "high") / F.count(F.lit(1))).alias("high_share"), (F.count_if(F.col("deadline_type") == "recurring") / F.count(F.lit(1))).alias("recurring_share"))
    return totals.crossJoin(F.broadcast(parties))  # one row each


def gaps_by_type(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("intermediary_types").alias("intermediary_type"), "evidence_status").groupBy("intermediary_type").agg(F.count(F.lit(1)).alias("obligations"), F.count_if(F.col("evidence_status") != "green").alias("gaps"))
