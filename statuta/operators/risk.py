"""Risk scores, the urgency queue, actions, alerts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import fields as X
from statuta.functions import lexicon as L
from statuta.functions.columns import choose
from statuta.operators.register import severity_at_least
from statuta.session import materialize


def with_days(register: DataFrame, as_of: Column) -> DataFrame:
    return register.withColumn("days_remaining", X.days_remaining(F.col("deadline"), F.col("deadline_type"), as_of))


def with_dependents(register: DataFrame, edges: DataFrame) -> DataFrame:
    """Add dependents, the number of edges that leave the obligation; 0 for one that is not in the graph."""
    out = edges.groupBy(F.col("src").alias("obligation_id")).agg(F.count(F.lit(1)).alias("dependents"))
    return register.join(out, "obligation_id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))


def scored(register: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """The register with days_remaining, dependents, risk_score and risk_label."""
    rows = with_dependents(with_days(register, as_of), edges)
    rows = rows.withColumn("risk_score", X.risk_score(F.col("severity"), F.col("evidence_status"), F.col("days_remaining"), F.col("dependents")))
    return rows.withColumn("risk_label", X.risk_label(F.col("risk_score")))


def sort_days(days: Column, zero_days_last: bool = True) -> Column:
    """Days for sorting; without any they come last, and so does 0 where ``zero_days_last``."""
    return F.when(days.isNull() | ((days == 0) & F.lit(zero_days_last)), 9999).otherwise(days)


def urgency_queue(rows: DataFrame, kind: str | None = None, limit: int | None = None, zero_days_last: bool = True) -> DataFrame:
    """Scored rows by risk, then days left, then id; with overdue."""
    if kind:
        rows = rows.filter(F.array_contains("intermediary_types", kind))
    out = rows.withColumn("overdue", F.coalesce(F.col("days_remaining") < 0, F.lit(False))).orderBy(F.desc("risk_score"), sort_days(F.col("days_remaining"), zero_days_last), "obligation_id")
    return out.limit(limit) if limit else out


def urgency_totals(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("total"), F.count_if("overdue").alias("overdue"), F.count_if(F.col("risk_label") == "High").alias("high_risk"))


def actions(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """An action per applicable obligation: priority, department, steps, overdue, status."""
    if kind:
        rows = rows.filter(F.array_contains("intermediary_types", kind))
    party = F.coalesce(F.nullif("responsible_party", F.lit("")), F.lit("Compliance Officer"))
    rank = X.priority(F.col("severity"), F.col("deadline_type"), F.col("days_remaining"))
    return rows.select(
        "obligation_id",
        "circular_id",
        X.department(F.col("responsible_party")).alias("department"),
        party.alias("owner"),
        rank.alias("priority"),
        F.col("deadline").alias("due_date"),
        "days_remaining",
        F.coalesce(F.col("days_remaining") < 0, F.lit(False)).alias("overdue"),
        F.concat(F.lit("["), F.upper(rank), F.lit("] "), F.col("title")).alias("title"),
        "description",
        X.default_steps(F.col("clause_reference"), F.col("required_action"), F.col("evidence_requirements"), F.col("responsible_party")).alias("steps"),
        F.col("evidence_requirements").alias("evidence_required"),
        F.slice("related_obligations", 1, 5).alias("dependencies"),
        F.when(F.col("days_remaining") < 0, "overdue").otherwise("open").alias("status"),
    )


def priority_rank(c: Column) -> Column:
    return choose(c, {"critical": 0, "high": 1, "medium": 2, "low": 3}, 9)


def in_order(acts: DataFrame) -> DataFrame:
    return acts.orderBy(priority_rank(F.col("priority")), F.coalesce("days_remaining", F.lit(9999)), "obligation_id")


def numbered(acts: DataFrame, buckets: int = 64) -> DataFrame:
    """Add action_id ACT-00001 … in the order of obligations.

    Rows are counted per range of ids, and a row's number is its place in the range plus the rows of the ranges before; no task sorts
    them all.
    """
    # written once, since two runs of a range exchange may draw different bounds
    ranged = materialize(acts.repartitionByRange(buckets, "obligation_id").withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("obligation_id"))
    out = ranged.withColumn("_p", place).join(F.broadcast(before), "_range")  # one row a range
    return out.withColumn("action_id", F.format_string("ACT-%05d", F.col("_before") + F.col("_p"))).drop("_range", "_c", "_before", "_p")


def first_per_obligation(acts: DataFrame, kind_position: str) -> DataFrame:
    """Of the same obligation's actions under several types, the one of the first type."""
    w = Window.partitionBy("obligation_id").orderBy(kind_position, priority_rank(F.col("priority")))
    return acts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def filtered(acts: DataFrame, register: DataFrame | None = None, priority: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Actions by priority and by the type of their obligation (which is really applied)."""
    out = acts.filter(F.col("priority") == priority) if priority else acts
    if kind and register is not None:
        out = out.join(register.filter(F.array_contains("intermediary_types", kind)).select("obligation_id"), "obligation_id", "left_semi")
    return out.limit(limit) if limit else out


def summary(acts: DataFrame, top: int = 3) -> DataFrame:
    """Departments, counts, effort days (3 a critical, 2 a high, 1 another) and the most urgent actions."""
    n = lambda p: F.count_if(F.col("priority") == p)
    totals = acts.agg(
        F.array_sort(F.collect_set("department")).alias("departments"),
        F.count(F.lit(1)).alias("total"),
        n("critical").alias("critical_tasks"),
        n("high").alias("high_tasks"),
        (n("critical") * 3 + n("high") * 2 + F.count(F.lit(1)) - n("critical") - n("high")).alias("effort_days"),
    )
    best = acts.orderBy(priority_rank(F.col("priority")), sort_days(F.col("days_remaining")), "obligation_id").limit(top)
    rank = F.struct(priority_rank(F.col("priority")).alias("r"), sort_days(F.col("days_remaining")).alias("d"), "obligation_id")
    listed = best.agg(F.transform(F.array_sort(F.collect_list(rank)), lambda s: s["obligation_id"]).alias("top_actions"))
    return totals.crossJoin(F.broadcast(listed))  # one row each


def alerts(queue: DataFrame, due_soon: int = 7, floor: str = "medium") -> DataFrame:
    """OVERDUE and DUE_SOON alerts of the urgency queue: severe enough and evidence not complete."""
    days = F.col("days_remaining")
    rule = F.when(F.col("overdue"), "OVERDUE").when(days.between(0, due_soon), "DUE_SOON")
    label = F.when(F.col("overdue"), F.format_string(L.ALERT_LABELS[0], F.abs(days))).otherwise(F.format_string(L.ALERT_LABELS[1], days))
    rows = queue.filter(severity_at_least(F.coalesce("severity", F.lit("low")), floor) & (F.coalesce("evidence_status", F.lit("red")) != "green"))
    return rows.withColumn("rule", rule).filter("rule is not null").withColumn("alert_label", label)


def new_high(register: DataFrame, as_of: Column, hours: int = 24, floor: str = "medium") -> DataFrame:
    """High-severity rows created within the last ``hours``, whatever their evidence."""
    since = as_of.cast("timestamp") - F.make_interval(hours=F.lit(hours))
    rows = register.filter((F.col("severity") == "high") & (F.col("created_at") >= since) & severity_at_least(F.col("severity"), floor))
    return rows.withColumn("rule", F.lit("NEW_HIGH")).withColumn("alert_label", F.lit("New HIGH obligation"))


def alert_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        *[F.count_if(F.col("rule") == r).alias(r.lower()) for r in ("OVERDUE", "DUE_SOON", "NEW_HIGH")],
        F.count(F.lit(1)).alias("total_alerts"),
        F.coalesce(F.bool_or((F.col("rule") == "OVERDUE") | (F.col("severity") == "high")), F.lit(False)).alias("has_critical"),
    )


def deadline_calendar(register: DataFrame, as_of: Column) -> DataFrame:
    """Obligations with a deadline; those with a date first, by days."""
    days = F.when(F.col("deadline_type") == "fixed", X.days_until(F.col("deadline"), as_of))
    rows = register.filter(F.coalesce("deadline", F.lit("")) != "").withColumn("days_remaining", days)
    return rows.orderBy(F.col("days_remaining").isNull(), F.coalesce("days_remaining", F.lit(0)), "obligation_id")


def report(rows: DataFrame, kind: str | None = None) -> DataFrame:
    """Applicable scored rows, high severity first."""
    rows = rows.filter(F.array_contains("intermediary_types", kind)) if kind else rows
    return rows.orderBy(F.col("severity") != "high", "obligation_id")


def with_steps(acts: DataFrame, register: DataFrame) -> DataFrame:
    """Actions with the six-step procedure of their obligation (left join)."""
    names = ("clause_reference", "required_action", "evidence_requirements", "responsible_party", "deadline")
    # only the fields are joined; the steps, some hundred characters a row, are written after it
    fields = register.select("obligation_id", F.struct(*names).alias("_of"))
    steps = X.template_steps(*[F.col(f"_of.{n}") for n in names])
    return acts.join(fields, "obligation_id", "left").withColumn("procedure", F.when(F.col("_of").isNotNull(), steps)).drop("_of")


def circular_card(rows: DataFrame, acts: DataFrame, high_ids: int = 5) -> DataFrame:
    """Per circular: obligations, types, tasks, up to five high-risk ids, gaps."""
    tasks = acts.groupBy("circular_id").agg(F.count(F.lit(1)).alias("tasks"))
    cards = rows.groupBy("circular_id").agg(
        F.count(F.lit(1)).alias("obligations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("intermediary_types")))).alias("types"),
        F.slice(F.array_sort(F.collect_set(F.when(F.col("risk_label") == "High", F.col("obligation_id")))), 1, high_ids).alias("high_risk"),
        F.count_if(F.col("evidence_status") != "green").alias("gaps"),
    )
    return cards.join(tasks, "circular_id", "left").withColumn("tasks", F.coalesce("tasks", F.lit(0)))
