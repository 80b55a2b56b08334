"""Compositions: change reports, the register commit, mapping to a type, document analysis, dialogue windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators import changes as CH
from statuta.operators import classify as CL
from statuta.operators import graph as G
from statuta.operators import insights as I
from statuta.operators import register as R
from statuta.operators import risk as K
from statuta.operators import text as T


def impact_band(affected: Column) -> Column:
    """More than five affected is high, any medium, none low."""
    return F.when(affected > 5, "high").when(affected > 0, "medium").otherwise("low")


def report_risk_level(high_changes: Column, affected: Column) -> Column:
    """Any high-severity change or more than 20 affected is high, more than 10 medium, else low."""
    return F.when((high_changes > 0) | (affected > 20), "high").when(affected > 10, "medium").otherwise("low")


def change_report(diff: DataFrame, new: DataFrame, spread: DataFrame, most_actions: int = 10) -> DataFrame:
    """One row: counts by class, high-severity changes, affected, risk level, impact score, ids to act on first."""
    changed = diff.filter("change_class <> 'UNCHANGED'").join(new.select(F.col("obligation_id").cast("string").alias("new_id"), "severity"), "new_id")
    high = changed.agg(F.count_if(F.col("severity") == "high").alias("high_changes"))
    first = changed.filter("severity = 'high'").orderBy("new_id").limit(most_actions).agg(F.array_sort(F.collect_list("new_id")).alias("priority_ids"))
    rows = CH.impact_score(diff)
    for one_row in (high, first, G.impact_totals(spread).select(F.col("total").alias("affected"))):
        rows = rows.crossJoin(F.broadcast(one_row))
    return rows.withColumn("risk_level", report_risk_level(F.col("high_changes"), F.col("affected"))).withColumn("impact_band", impact_band(F.col("affected")))


def change_lines(diff: DataFrame, titles: DataFrame, new: int = 3, modified: int = 2, superseded: DataFrame | None = None, gone: int = 2) -> DataFrame:
    """(position, line): the first new and modified titles and superseded ids; titles has new_id and title."""
    named = diff.join(titles, "new_id")
    pick = lambda c, n, rank: named.filter(F.col("change_class") == c).orderBy("new_id").limit(n).select(F.lit(rank).alias("part"), F.col("new_id").alias("id"), F.concat(F.lit(f"{c}: "), "title").alias("line"))
    rows = pick("NEW", new, 0).unionByName(pick("MODIFIED", modified, 1))
    if superseded is not None:
        rows = rows.unionByName(superseded.orderBy("old_id").limit(gone).select(F.lit(2).alias("part"), F.col("old_id").cast("string").alias("id"), F.concat(F.lit("SUPERSEDED: "), F.col("old_id").cast("string")).alias("line")))
    # at most a handful of rows, so one task may number them
    return rows.select((F.row_number().over(Window.orderBy("part", "id"))).alias("position"), "line")


def diff_or_all_new(new: DataFrame, existing: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """A response's classification where it says anything, else the lexical diff (all NEW against an empty register)."""
    if classes is not None and not classes.isEmpty() and not existing.isEmpty():
        return CH.diff_from_responses(new, classes).withColumn("similarity", F.lit(None).cast("double")).select("new_id", "old_id", "change_class", "similarity", "changes", "method")
    return CH.lexical_diff(new, existing)


def commit(register: DataFrame, edges: DataFrame, new: DataFrame, superseded: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The register and edges after a batch: keyed upsert, edges rebuilt from related ids, supersessions, fresh scores."""
    rows = R.apply_supersessions(R.upsert(register, new), superseded)
    links = edges.withColumn("_batch", F.lit(0)).unionByName(G.edges_from_related(new).withColumn("_batch", F.lit(1)))
    kept = G.deduplicate(links, "_batch").drop("_batch")
    base = rows.drop("days_remaining", "dependents", "risk_score", "risk_label")
    return K.scored(base, kept, as_of), kept


def map_to_type(register: DataFrame, kind: str, refused: DataFrame | None = None) -> dict[str, DataFrame]:
    """Applicable and not applicable obligations of a type, critical gaps, action items.

    ``refused`` (obligation_id) takes rows that a review found not applicable out of the applicable ones.
    """
    own = R.applicable(register, kind)
    out = own.limit(0).select("obligation_id")
    if refused is not None:
        out = own.join(refused.select("obligation_id"), "obligation_id", "left_semi").select("obligation_id")
        own = own.join(refused.select("obligation_id"), "obligation_id", "left_anti")
    return {"applicable": own, "not_applicable": out, "critical_gaps": R.critical_gaps(own), "action_items": R.action_items(own)}


def preview(obligations: DataFrame) -> DataFrame:
    """The twelve columns that a preview shows."""
    return obligations.select(
        "obligation_id", "title", "description", "clause_reference", "severity", F.col("confidence_score").alias("confidence"), "deadline", "deadline_type", "responsible_party", "intermediary_types",
        "evidence_requirements", F.col("extraction_rationale").alias("rationale"),
    )


def analyze(docs: DataFrame, as_of: Column, scorer: Callable[[DataFrame], DataFrame] = CL.rule_scores, recognition: DataFrame | None = None, threshold: float = 0.55) -> dict[str, DataFrame]:
    """Everything about a corpus of documents (circular_id, title, document_text), a table for each part."""
    obligations = CL.extract_obligations(docs, scorer, threshold)
    units = T.units(docs)
    profiles = I.profile(docs)
    metrics = I.summary_metrics(obligations, profiles)
    return {
        "document_profile": profiles,
        "keywords": I.keyword_profile(docs),
        "sections": I.section_profile(units),
        "obligations": obligations,
        "preview": preview(obligations),
        "rejected": CL.borderline(scorer(units.filter(~T.is_boilerplate(F.col("sentence")))), threshold),
        "distributions": R.distributions(obligations),
        "calendar": K.deadline_calendar(obligations, as_of),
        "summary_metrics": metrics,
        "findings": I.findings(metrics, profiles, recognition),
    }


def dialogue_window(turns: DataFrame, key: str = "conv_id", order: str = "turn", last: int = 6, length: int = 600) -> DataFrame:
    """Per conversation, its last turns in order, each cut to ``length`` characters."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    rows = turns.withColumn("_n", n).filter(F.col("_n") <= last)
    cut = F.struct(order, F.concat(F.col("role"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, length)).alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cut)), lambda s: s["line"]), "\n").alias("dialogue"))
