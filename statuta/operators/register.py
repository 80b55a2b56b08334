"""The obligation register: listing, search, upsert, statistics, gaps, mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window

from statuta.functions import fields as X
from statuta.functions import lexicon as L
from statuta.functions.columns import choose


def listing(register: DataFrame, kind: str | None = None, severity: str | None = None, status: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the register in id order, with the total of all matching rows."""
    rows = register
    if kind:
        rows = rows.filter(F.array_contains("intermediary_types", kind))
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if status:
        rows = rows.filter(F.col("status") == status)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("obligation_id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def by_id(register: DataFrame, obligation_id: object) -> DataFrame:
    return register.filter(F.col("obligation_id") == obligation_id)


def by_circular(register: DataFrame, circular_id: object) -> DataFrame:
    return register.filter(F.col("circular_id") == circular_id)


def keyword_search(register: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Rows whose title, description or any keyword holds the query, in any case."""
    q = query.lower()
    hit = F.lower("title").contains(q) | F.lower("description").contains(q) | F.exists("keywords", lambda k: F.lower(k).contains(q))
    rows = register.filter(F.coalesce(hit, F.lit(False)))
    return rows.filter(F.array_contains("intermediary_types", kind)) if kind else rows


def workflow_search(register: DataFrame, query: str) -> DataFrame:
    return register.filter(F.exists("keywords", lambda k: F.lower(k).contains(query.lower())))


def search(register: DataFrame, query: str, kind: str | None = None, matches: DataFrame | None = None) -> DataFrame:
    """Vector matches (obligation_id, similarity) joined to the register where there are any, else keyword search.

    The type filter holds on both paths.
    """
    if matches is None:
        return keyword_search(register, query, kind)
    rows = register.join(matches, "obligation_id")
    return rows.filter(F.array_contains("intermediary_types", kind)) if kind else rows


def explain_fields(register: DataFrame) -> DataFrame:
    return register.select("obligation_id", F.coalesce(F.nullif("extraction_rationale", F.lit("")), F.lit("No rationale recorded.")).alias("rationale"), "confidence_score", "mandatory_keywords")


def evidence_gaps(register: DataFrame, circular_id: object = None) -> DataFrame:
    """Rows whose evidence is not green; red first, then yellow, high severity first."""
    rows = register.filter(F.coalesce(F.col("evidence_status"), F.lit("red")) != "green")
    if circular_id is not None:
        rows = by_circular(rows, circular_id)
    return rows.orderBy(choose(F.col("evidence_status"), {"red": 0, "yellow": 1}, 2), F.col("severity") != "high", "obligation_id")


def critical_gaps(register: DataFrame) -> DataFrame:
    """High severity and not green, with the kind of gap."""
    rows = register.filter((F.col("severity") == "high") & (F.col("evidence_status") != "green"))
    return rows.withColumn("gap_type", F.when(F.col("evidence_status") == "red", "evidence").otherwise("process"))


def severity_at_least(severity: Column, floor: str) -> Column:
    """low < medium < high; an unknown severity is low, an unknown floor medium."""
    return X.severity_rank(severity) >= {"low": 0, "medium": 1, "high": 2}.get(floor, 1)


def applicable(register: DataFrame, kind: str) -> DataFrame:
    return register.filter(F.array_contains("intermediary_types", kind))


def not_applicable(register: DataFrame, kind: str) -> DataFrame:
    return register.filter(~F.coalesce(F.array_contains("intermediary_types", kind), F.lit(False)))


def _orderable(kind: DataType) -> bool:
    """Whether Spark can sort by values of this type, which holds for all but maps and variants and what contains them."""
    text = kind.simpleString()
    return not any(word in text for word in ("map<", "variant", "interval"))


def upsert(register: DataFrame, batch: DataFrame, keys: Sequence[str] = ("obligation_id",), order: str | None = None) -> DataFrame:
    """Rows of the batch replace those of the register with the same key; of several in a batch the last by ``order`` stays.

    Rows of equal order are told apart by their other columns from left to right; the largest values stay, so the result does
    not depend on the order in which rows are read.
    """
    new = batch.withColumn("_batch", F.lit(1)).withColumn("_order", F.col(order) if order else F.lit(0))
    both = register.withColumn("_batch", F.lit(0)).withColumn("_order", F.lit(None).cast(new.schema["_order"].dataType)).unionByName(new)
    ties = [f.name for f in register.schema if f.name not in (*keys, order) and _orderable(f.dataType)]
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"), F.desc("_order"), *[F.desc(f"`{c}`") for c in ties])
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_batch", "_order", "_n")


def apply_supersessions(register: DataFrame, superseded: DataFrame) -> DataFrame:
    """Mark old rows as superseded by new ones; ``superseded`` has old_id and new_id."""
    by = superseded.groupBy("old_id").agg(F.array_sort(F.collect_set("new_id")).alias("_by"))
    joined = register.join(by, register["obligation_id"] == by["old_id"], "left").drop("old_id")
    return joined.withColumn("status", F.when(F.col("_by").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("superseded_by", F.coalesce("_by", "superseded_by")).drop("_by")


def statistics(register: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, with the density edges / nodes."""
    flag = lambda c, v: F.count_if(F.col(c) == v)
    totals = register.agg(
        F.count(F.lit(1)).alias("total_obligations"),
        flag("status", "active").alias("active"),
        flag("status", "superseded").alias("superseded"),
        flag("evidence_status", "green").alias("evidence_complete"),
        flag("evidence_status", "yellow").alias("evidence_partial"),
        flag("evidence_status", "red").alias("evidence_missing"),
        flag("severity", "high").alias("high_severity"),
        F.countDistinct("circular_id").alias("circulars"),
    )
    return totals.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).withColumn("density", F.col("edges") / F.greatest("total_obligations", F.lit(1)))


def evidence_groups(register: DataFrame, kind: str | None = None, samples: int = 10) -> DataFrame:
    """Per evidence status: count over all types, count of the type, and sample ids of the type in id order."""
    own = applicable(register, kind) if kind else register
    everything = register.groupBy("evidence_status").agg(F.count(F.lit(1)).alias("count_all"))
    counted = own.groupBy("evidence_status").agg(F.count(F.lit(1)).alias("count_type"))
    ranked = own.withColumn("_n", F.row_number().over(Window.partitionBy("evidence_status").orderBy("obligation_id"))).filter(F.col("_n") <= samples)
    sample = ranked.groupBy("evidence_status").agg(F.array_sort(F.collect_list("obligation_id")).alias("samples"))
    return everything.join(counted, "evidence_status", "left").join(sample, "evidence_status", "left").withColumn("count_type", F.coalesce("count_type", F.lit(0)))


def per_type(register: DataFrame) -> DataFrame:
    """One row per obligation and type."""
    return register.withColumn("intermediary_type", F.explode("intermediary_types"))


def dashboard(register: DataFrame) -> DataFrame:
    """Totals, evidence and severity split, gaps and action items of every type."""
    on = lambda c, v: F.count_if(F.col(c) == v)
    return per_type(register).groupBy("intermediary_type").agg(
        F.count(F.lit(1)).alias("total_obligations"),
        on("evidence_status", "green").alias("complete"),
        on("evidence_status", "yellow").alias("partial"),
        F.count_if(~F.coalesce(F.col("evidence_status").isin("green", "yellow"), F.lit(False))).alias("missing"),
        on("severity", "high").alias("critical"),
        on("severity", "medium").alias("normal"),
        on("severity", "low").alias("low"),
        F.count_if((F.col("severity") == "high") & (F.col("evidence_status") != "green")).alias("critical_gaps"),
        F.count(F.lit(1)).alias("action_items"),
    )


def compliance_scores(register: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Weighted share of met obligations per type (yellow counts half); 100 for a type of ``kinds`` without any."""
    weight = choose(F.col("severity"), L.SEVERITY_WEIGHTS, 1.0)
    credit = F.when(F.col("evidence_status") == "green", 1.0).when(F.col("evidence_status") == "yellow", 0.5).otherwise(0.0)
    scores = per_type(register).groupBy("intermediary_type").agg((F.sum(weight * credit) / F.sum(weight) * 100).alias("score"), F.count(F.lit(1)).alias("obligations"))
    if not kinds:
        return scores.withColumn("score", F.bround("score", 1))
    asked = register.sparkSession.createDataFrame([(k,) for k in kinds], "intermediary_type string")
    return F.broadcast(asked).join(scores, "intermediary_type", "left").select("intermediary_type", F.bround(F.coalesce("score", F.lit(100.0)), 1).alias("score"), F.coalesce("obligations", F.lit(0)).alias("obligations"))


def overall_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.bround(F.coalesce(F.avg("score"), F.lit(100.0)), 1).alias("overall"))


def action_items(register: DataFrame) -> DataFrame:
    """Action items in the order of responsible party, high severity first, then deadline text: one global sort."""
    items = register.select(
        "responsible_party",
        "obligation_id",
        F.when(F.col("severity") == "high", "critical").otherwise("normal").alias("priority"),
        F.col("required_action").alias("action"),
        F.coalesce(F.nullif("deadline", F.lit("")), F.lit("To be determined")).alias("deadline"),
        F.col("evidence_requirements").alias("evidence_needed"),
        X.effort(F.col("description"), L.MAPPING_EFFORT).alias("estimated_effort"),
        F.slice("related_obligations", 1, 3).alias("dependencies"),
        F.coalesce("deadline", F.lit("")).alias("_deadline"),
    )
    return items.orderBy("responsible_party", F.col("priority") != "critical", "_deadline", "obligation_id").drop("_deadline")


def type_severity_pivot(register: DataFrame, severities: Sequence[str] = ("high", "medium", "low")) -> DataFrame:
    rows = per_type(register).groupBy("intermediary_type").pivot("severity", list(severities)).count().fillna(0)
    return rows.withColumn("total", sum((F.col(s) for s in severities), F.lit(0)))


def distributions(register: DataFrame, top_parties: int = 8) -> DataFrame:
    """Counts by severity, deadline type, type, the leading parties and confidence: columns dimension, value, n."""
    count = lambda c, name, df=register: df.groupBy(c.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dimension"), "value", "n")
    parties = count(F.col("responsible_party"), "responsible_party").orderBy(F.desc("n"), "value").limit(top_parties)
    out = count(F.col("severity"), "severity").unionByName(count(F.coalesce("deadline_type", F.lit("not_specified")), "deadline_type"))
    out = out.unionByName(count(F.col("intermediary_type"), "intermediary_type", per_type(register))).unionByName(parties)
    return out.unionByName(count(X.confidence_bucket(F.col("confidence_score")), "confidence")) if "confidence_score" in register.columns else out


def circulars(register: DataFrame) -> DataFrame:
    return register.select("circular_id").distinct()


def version_timeline(register: DataFrame) -> DataFrame:
    """History entries and, where the history lacks it, the current version, in the order of versions.

    ``version_history`` is array<struct<version, status>>.
    """
    own = F.struct(F.col("version").alias("version"), F.col("status").alias("status"))
    has = F.exists("version_history", lambda v: v["version"] == F.col("version"))
    whole = F.when(has, F.col("version_history")).otherwise(F.concat("version_history", F.array(own)))
    return register.select("obligation_id", F.array_sort(whole).alias("timeline"))


def highest(register: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` rows of the highest severity and, within it, the highest confidence; ties by id."""
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    return register.orderBy(F.desc(rank), F.desc_nulls_last("confidence_score"), "obligation_id").limit(k)
