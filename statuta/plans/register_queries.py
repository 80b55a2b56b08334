"""Queries over the register: lists of (name, query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import fields as X
from statuta.operators import evidence as E
from statuta.operators import register as R
from statuta.operators import risk as K
from statuta.plans import views as V
from statuta.sources import dataset as D
from statuta.sources import writers as W

SCORES = "WITH " + V.SCORED
PLAIN = "WITH " + V.REGISTER
PRIORITY = """CASE WHEN days_remaining < 0 THEN 'critical' WHEN days_remaining <= 7 AND base IN ('medium','low') THEN 'high' ELSE base END"""
ACTS = (
    SCORES
    + """, based AS (SELECT *, CASE severity || '|' || deadline_type WHEN 'high|fixed' THEN 'critical' WHEN 'high|recurring' THEN 'high' WHEN 'high|relative' THEN 'critical'
    WHEN 'medium|fixed' THEN 'high' WHEN 'medium|recurring' THEN 'medium' WHEN 'medium|relative' THEN 'high' WHEN 'low|fixed' THEN 'medium' WHEN 'low|recurring' THEN 'low' WHEN 'low|relative' THEN 'medium' END base FROM ranked),
  acts AS (SELECT *, """
    + PRIORITY
    + """ priority, CASE WHEN lower(responsible_party) LIKE '%compliance%' THEN 'Compliance' ELSE 'Compliance' END department FROM based)"""
)


def scored(spark, d):
    return K.scored(V.register(spark, d), V.order_edges(spark, d), V.as_of())


def queue(spark, d):
    return K.urgency_queue(scored(spark, d))


def urgency_queue(spark, d):
    return queue(spark, d).select("obligation_id", "risk_score", "risk_label", "days_remaining", "overdue", "dependents")


def urgency_top_200(spark, d):
    return K.urgency_queue(scored(spark, d), limit=200).select("obligation_id", "risk_score", "days_remaining")


def priority_actions(spark, d):
    return K.actions(scored(spark, d)).select("obligation_id", "department", "owner", "priority", "overdue", "title", F.array_join("steps", "\n").alias("steps"))


STEPS = """'Step 1: Review ' || clause_reference || ' in the source circular and confirm applicability.' || chr(10) || 'Step 2: File the report' || chr(10)
  || 'Step 3: Update internal policy / procedures to reflect new requirement.' || chr(10) || 'Step 4: Collect and document evidence: ' || array_to_string(evidence_requirements, ', ') || '.' || chr(10)
  || 'Step 5: Submit completed checklist to ' || responsible_party || ' for sign-off.'"""


def numbered_actions(spark, d):
    return K.numbered(K.actions(scored(spark, d))).select("action_id", "obligation_id", "priority")


def action_summary(spark, d):
    return K.summary(K.actions(scored(spark, d))).select(F.array_join("departments", ",").alias("departments"), "total", "critical_tasks", "high_tasks", "effort_days", F.array_join(F.col("top_actions").cast("array<string>"), ",").alias("top_actions"))


def first_occurrence_dedupe(spark, d):
    acts = K.actions(scored(spark, d)).join(V.register(spark, d).select("obligation_id", F.posexplode("intermediary_types").alias("type_position", "kind")), "obligation_id")
    return K.first_per_obligation(acts, "type_position").select("obligation_id", "kind", "priority")


def alerts_due_overdue(spark, d):
    return K.alerts(queue(spark, d)).select("obligation_id", "rule", "alert_label", "severity")


def alerts_new_high(spark, d):
    return K.new_high(V.register(spark, d), V.as_of(), hours=24 * 60).select("obligation_id", "rule", "evidence_status")


def alert_totals(spark, d):
    both = K.alerts(queue(spark, d)).select("rule", "severity").unionByName(K.new_high(V.register(spark, d), V.as_of(), hours=24 * 60).select("rule", "severity"))
    return K.alert_totals(both)


def circular_cards(spark, d):
    rows = scored(spark, d)
    return K.circular_card(rows, K.actions(rows)).select("circular_id", "obligations", F.array_join("types", ",").alias("types"), F.array_join(F.col("high_risk").cast("array<string>"), ",").alias("high_risk"), "gaps", "tasks")


def deadline_calendar(spark, d):
    return K.deadline_calendar(V.register(spark, d), V.as_of()).select("obligation_id", "deadline", "days_remaining")


def compliance_scores(spark, d):
    return R.compliance_scores(V.register(spark, d)).select("intermediary_type", "score", "obligations")


def evidence_gaps(spark, d):
    return R.evidence_gaps(V.register(spark, d)).select("obligation_id", "evidence_status", "severity")


def critical_gaps(spark, d):
    return R.critical_gaps(V.register(spark, d)).select("obligation_id", "gap_type")


def register_stats(spark, d):
    return R.statistics(V.register(spark, d), V.order_edges(spark, d))


def evidence_groups(spark, d):
    return R.evidence_groups(V.register(spark, d), "AF").select("evidence_status", "count_all", "count_type", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


def action_items_by_party(spark, d):
    return R.action_items(V.register(spark, d)).select("responsible_party", "obligation_id", "priority", "deadline", "estimated_effort", F.array_join("evidence_needed", ",").alias("evidence_needed"))


def distributions(spark, d):
    return R.distributions(V.register(spark, d))


def latest_per_key_upsert(spark, d):
    reg = V.register(spark, d).select("obligation_id", "severity", "status")
    lines = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obligation_id"), F.col("l_returnflag").alias("severity"), F.lit("changed").alias("status"), "l_linenumber")
    return R.upsert(reg.withColumn("l_linenumber", F.lit(None).cast("int")), lines, order="l_linenumber").select("obligation_id", "severity", "status")


def supersessions(spark, d):
    reg = V.register(spark, d)
    pairs = V.order_edges(spark, d).select(F.col("src").alias("old_id"), F.col("dst").alias("new_id"))
    return R.apply_supersessions(reg, pairs).select("obligation_id", "status", F.array_join(F.col("superseded_by").cast("array<string>"), ",").alias("superseded_by"))


def version_timeline(spark, d):
    lines = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("obligation_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("version"), F.col("l_linestatus").alias("status"))).alias("version_history"))
    rows = V.register(spark, d).select("obligation_id", "status").join(lines, "obligation_id").withColumn("version", F.lit(4))
    return R.version_timeline(rows).select("obligation_id", F.array_join(F.transform("timeline", lambda v: F.concat_ws(":", v["version"].cast("string"), v["status"])), ",").alias("timeline"))


def seen_anti_join(spark, d):
    entries = V.table(spark, d, "pages").select(F.col("url").alias("detail_url"), "page_id")
    seen = V.table(spark, d, "pages").filter("html like '%<table%'").select(F.col("url").alias("detail_url"))
    return W.unseen(entries, seen).select("page_id", X.url_hash(F.col("detail_url")).alias("url_hash"))


def events_log(spark, d):
    kind = F.when(F.col("event_type") == "signup", "pipeline_completed").otherwise(F.col("event_type"))
    return V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), kind.alias("event_type"), F.col("user_id").cast("string").alias("circular_id"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"), "value", "event_id", "props")


def audit_summary(spark, d):
    return W.audit_summary(events_log(spark, d))


def latest_run(spark, d):
    return W.latest(events_log(spark, d), "timestamp", "event_id", by="circular_id").select("circular_id", "event_id", "event_type")


def daily_signup_counts(spark, d):
    from statuta.streaming.ingest import daily_counts

    return daily_counts(events_log(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def event_properties(spark, d):
    return events_log(spark, d).select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def confidence_buckets(spark, d):
    rows = events_log(spark, d).filter("value is not null").select((F.col("value") % 1.0).alias("c"))
    return rows.groupBy(X.confidence_bucket(F.col("c")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def checklist_progress(spark, d):
    items = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obligation_id"), F.col("l_linenumber").alias("item_id"), (F.col("l_linestatus") == "F").alias("completed"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus").alias("ts"))
    return E.fold_updates(items)


def latest_evidence(spark, d):
    results = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obligation_id"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_partkey", "l_suppkey", "l_linenumber")]).alias("filename"), F.when(F.col("l_linestatus") == "F", "green").otherwise("yellow").alias("evidence_status"), F.col("l_shipdate").alias("uploaded_at"))
    return E.apply_latest(V.register(spark, d).select("obligation_id", "evidence_status"), results)


def keyword_search(spark, d):
    return R.keyword_search(V.register(spark, d), "URGENT", "AF").select("obligation_id")


def listing_page(spark, d):
    return R.listing(V.register(spark, d), kind="NO", severity="high", status="active", offset=100, limit=50).select("obligation_id", "total")


def type_severity_pivot(spark, d):
    return R.type_severity_pivot(V.register(spark, d))


def dashboard_by_type(spark, d):
    return R.dashboard(V.register(spark, d))


def gaps_by_type(spark, d):
    return D.gaps_by_type(V.register(spark, d))


def dataset_profile(spark, d):
    return D.profile(V.register(spark, d))


def dataset_shares(spark, d):
    return D.shares(V.register(spark, d))


def overall_compliance(spark, d):
    return R.overall_score(R.compliance_scores(V.register(spark, d)))


def urgency_totals(spark, d):
    return K.urgency_totals(queue(spark, d))


def circular_list(spark, d):
    return R.circulars(V.register(spark, d))


def not_applicable(spark, d):
    return R.not_applicable(V.register(spark, d), "RF").select("obligation_id")


def compliance_report(spark, d):
    return K.report(scored(spark, d), "RF").select("obligation_id", "severity", "evidence_status", "risk_score")


def template_procedures(spark, d):
    rows = scored(spark, d)
    return K.with_steps(K.actions(rows), V.register(spark, d)).select("obligation_id", F.size("procedure").alias("steps"), F.get("procedure", F.lit(4)).alias("fifth"))


QUERIES = [
    (urgency_queue, SCORES + " SELECT obligation_id, risk_score, risk_label, days_remaining, coalesce(days_remaining < 0, false) overdue, dependents FROM ranked"),
    (urgency_top_200, SCORES + " SELECT obligation_id, risk_score, days_remaining FROM ranked ORDER BY risk_score DESC, CASE WHEN days_remaining IS NULL OR days_remaining = 0 THEN 9999 ELSE days_remaining END, obligation_id LIMIT 200"),
    (urgency_totals, SCORES + " SELECT count(*) total, count(*) FILTER (days_remaining < 0) overdue, count(*) FILTER (risk_label = 'High') high_risk FROM ranked"),
    (priority_actions, ACTS + f" SELECT obligation_id, department, responsible_party AS owner, priority, days_remaining < 0 overdue, '[' || upper(priority) || '] ' || title AS title, {STEPS} AS steps FROM acts"),
    (numbered_actions, ACTS + " SELECT 'ACT-' || lpad(CAST(row_number() OVER (ORDER BY obligation_id) AS VARCHAR), CAST(greatest(5, length(CAST(row_number() OVER (ORDER BY obligation_id) AS VARCHAR))) AS INTEGER), '0') action_id, obligation_id, priority FROM acts"),
    (
        action_summary,
        ACTS
        + """, best AS (SELECT obligation_id, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE WHEN days_remaining = 0 THEN 9999 ELSE days_remaining END, obligation_id) n FROM acts)
  SELECT array_to_string(list_sort(list(DISTINCT department)), ',') departments, count(*) total, count(*) FILTER (priority = 'critical') critical_tasks, count(*) FILTER (priority = 'high') high_tasks,
  count(*) + 2 * count(*) FILTER (priority = 'critical') + count(*) FILTER (priority = 'high') effort_days, (SELECT string_agg(obligation_id, ',' ORDER BY n) FROM best WHERE n <= 3) top_actions FROM acts""",
    ),
    (first_occurrence_dedupe, ACTS + " SELECT obligation_id, intermediary_types[1] kind, priority FROM acts WHERE len(intermediary_types) > 0"),
    (
        alerts_due_overdue,
        SCORES
        + """ SELECT obligation_id, CASE WHEN days_remaining < 0 THEN 'OVERDUE' ELSE 'DUE_SOON' END AS "rule", CASE WHEN days_remaining < 0 THEN 'OVERDUE by ' || -days_remaining || ' days' ELSE 'Due in ' || days_remaining || ' days' END alert_label, severity
  FROM ranked WHERE severity IN ('medium','high') AND evidence_status <> 'green' AND days_remaining <= 7""",
    ),
    (alerts_new_high, PLAIN + f""" SELECT obligation_id, 'NEW_HIGH' AS "rule", evidence_status FROM register WHERE severity = 'high' AND created_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 60 DAY"""),
    (
        alert_totals,
        SCORES
        + f""", a AS (SELECT CASE WHEN days_remaining < 0 THEN 'OVERDUE' ELSE 'DUE_SOON' END r, severity FROM ranked WHERE severity IN ('medium','high') AND evidence_status <> 'green' AND days_remaining <= 7
  UNION ALL SELECT 'NEW_HIGH', severity FROM register WHERE severity = 'high' AND created_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 60 DAY)
  SELECT count(*) FILTER (r = 'OVERDUE') overdue, count(*) FILTER (r = 'DUE_SOON') due_soon, count(*) FILTER (r = 'NEW_HIGH') new_high, count(*) total_alerts, bool_or(r = 'OVERDUE' OR severity = 'high') has_critical FROM a""",
    ),
    (
        circular_cards,
        SCORES
        + """ SELECT circular_id, count(*) obligations, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT unnest(flatten(list(intermediary_types))) x)), '') types,
  coalesce(array_to_string(list_sort(list(obligation_id) FILTER (risk_label = 'High'))[1:5], ','), '') high_risk, count(*) FILTER (evidence_status <> 'green') gaps, count(*) tasks FROM ranked GROUP BY circular_id""",
    ),
    (deadline_calendar, PLAIN + " SELECT obligation_id, deadline, CASE WHEN deadline_type = 'fixed' THEN days_remaining END days_remaining FROM register"),
    (
        compliance_scores,
        PLAIN
        + """, w AS (SELECT unnest(intermediary_types) intermediary_type, CASE severity WHEN 'high' THEN 3.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END w, CASE evidence_status WHEN 'green' THEN 1.0::DOUBLE WHEN 'yellow' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END c FROM register)
  SELECT intermediary_type, round_even(sum(w * c) / sum(w) * 100, 1) score, count(*) obligations FROM w GROUP BY 1""",
    ),
    (
        overall_compliance,
        PLAIN
        + """, w AS (SELECT unnest(intermediary_types) intermediary_type, CASE severity WHEN 'high' THEN 3.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END w, CASE evidence_status WHEN 'green' THEN 1.0::DOUBLE WHEN 'yellow' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END c FROM register),
  s AS (SELECT round_even(sum(w * c) / sum(w) * 100, 1) score FROM w GROUP BY intermediary_type) SELECT round_even(avg(score), 1) overall FROM s""",
    ),
    (evidence_gaps, PLAIN + " SELECT obligation_id, evidence_status, severity FROM register WHERE evidence_status <> 'green'"),
    (critical_gaps, PLAIN + " SELECT obligation_id, CASE WHEN evidence_status = 'red' THEN 'evidence' ELSE 'process' END gap_type FROM register WHERE severity = 'high' AND evidence_status <> 'green'"),
    (
        register_stats,
        PLAIN
        + ", "
        + V.ORDER_EDGES
        + """ SELECT count(*) total_obligations, count(*) FILTER (status = 'active') active, count(*) FILTER (status = 'superseded') superseded, count(*) FILTER (evidence_status = 'green') evidence_complete,
  count(*) FILTER (evidence_status = 'yellow') evidence_partial, count(*) FILTER (evidence_status = 'red') evidence_missing, count(*) FILTER (severity = 'high') high_severity, count(DISTINCT circular_id) circulars,
  (SELECT count(*) FROM order_edges) edges, (SELECT count(*) FROM order_edges) / count(*)::DOUBLE density FROM register""",
    ),
    (
        evidence_groups,
        PLAIN
        + """, own AS (SELECT * FROM register WHERE list_contains(intermediary_types, 'AF'))
  SELECT evidence_status, count(*) count_all, (SELECT count(*) FROM own o WHERE o.evidence_status = r.evidence_status) count_type,
  (SELECT string_agg(obligation_id, ',' ORDER BY obligation_id) FROM (SELECT obligation_id FROM own o WHERE o.evidence_status = r.evidence_status ORDER BY 1 LIMIT 10)) samples FROM register r GROUP BY evidence_status""",
    ),
    (
        dashboard_by_type,
        PLAIN
        + """, e AS (SELECT *, unnest(intermediary_types) intermediary_type FROM register) SELECT intermediary_type, count(*) total_obligations, count(*) FILTER (evidence_status = 'green') complete, count(*) FILTER (evidence_status = 'yellow') partial,
  count(*) FILTER (evidence_status NOT IN ('green','yellow')) missing, count(*) FILTER (severity = 'high') critical, count(*) FILTER (severity = 'medium') normal, count(*) FILTER (severity = 'low') low,
  count(*) FILTER (severity = 'high' AND evidence_status <> 'green') critical_gaps, count(*) action_items FROM e GROUP BY 1""",
    ),
    (action_items_by_party, PLAIN + " SELECT responsible_party, obligation_id, CASE severity WHEN 'high' THEN 'critical' ELSE 'normal' END priority, deadline, 'high' estimated_effort, array_to_string(evidence_requirements, ',') evidence_needed FROM register"),
    (
        type_severity_pivot,
        PLAIN + ", e AS (SELECT unnest(intermediary_types) intermediary_type, severity FROM register) SELECT intermediary_type, count(*) FILTER (severity = 'high') high, count(*) FILTER (severity = 'medium') medium, count(*) FILTER (severity = 'low') low, count(*) total FROM e GROUP BY 1",
    ),
    (
        distributions,
        PLAIN
        + """ SELECT 'severity' dimension, severity "value", count(*) n FROM register GROUP BY 2 UNION ALL SELECT 'deadline_type', deadline_type, count(*) FROM register GROUP BY 2
  UNION ALL SELECT 'intermediary_type', t, count(*) FROM (SELECT unnest(intermediary_types) t FROM register) GROUP BY 2 UNION ALL (SELECT 'responsible_party', responsible_party, count(*) n FROM register GROUP BY 2 ORDER BY n DESC, 2 LIMIT 8)""",
    ),
    (
        latest_per_key_upsert,
        PLAIN
        + """, b AS (SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_returnflag)) f FROM lineitem GROUP BY 1) SELECT obligation_id, coalesce(f, severity) severity, CASE WHEN f IS NULL THEN status ELSE 'changed' END status FROM register LEFT JOIN b ON l_orderkey = obligation_id
  UNION ALL SELECT l_orderkey, f, 'changed' FROM b WHERE l_orderkey NOT IN (SELECT obligation_id FROM register)""",
    ),
    (supersessions, PLAIN + ", " + V.ORDER_EDGES + " SELECT obligation_id, CASE WHEN dst IS NULL THEN status ELSE 'superseded' END status, coalesce(CAST(dst AS VARCHAR), '') superseded_by FROM register LEFT JOIN order_edges ON src = obligation_id"),
    (
        version_timeline,
        PLAIN
        + """, l AS (SELECT l_orderkey, l_linenumber v, l_linestatus s FROM lineitem UNION ALL SELECT obligation_id, 4, status FROM register WHERE obligation_id IN (SELECT l_orderkey FROM lineitem) AND obligation_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4))
  SELECT l_orderkey obligation_id, string_agg(v || ':' || s, ',' ORDER BY v, s) timeline FROM l WHERE l_orderkey IN (SELECT obligation_id FROM register) GROUP BY 1""",
    ),
    (seen_anti_join, "SELECT page_id, md5(url)[1:8] url_hash FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE html LIKE '%<table%')"),
    (audit_summary, "SELECT count(*) events, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) circulars_completed, count(*) FILTER (event_type = 'error') failures, arg_max(CASE event_type WHEN 'signup' THEN 'pipeline_completed' ELSE event_type END, (ts, event_type)) last_event FROM events"),
    (latest_run, "SELECT CAST(user_id AS VARCHAR) circular_id, arg_max(event_id, (ts, event_id)) event_id, arg_max(CASE event_type WHEN 'signup' THEN 'pipeline_completed' ELSE event_type END, (ts, event_id)) event_type FROM events GROUP BY user_id"),
    (daily_signup_counts, "SELECT strftime(ts, '%Y-%m-%d') \"day\", CASE event_type WHEN 'signup' THEN 'pipeline_completed' ELSE event_type END event_type, count(*) n FROM events GROUP BY 1, 2"),
    (event_properties, "SELECT event_id, CAST(props->>'k' AS INTEGER) k FROM events"),
    (confidence_buckets, "SELECT CASE WHEN c >= 0.9 THEN '0.9–1.0' WHEN c >= 0.8 THEN '0.8–0.9' WHEN c >= 0.7 THEN '0.7–0.8' WHEN c >= 0.6 THEN '0.6–0.7' ELSE '0.55–0.6' END bucket, count(*) n FROM (SELECT value % 1.0::DOUBLE c FROM events WHERE value IS NOT NULL) GROUP BY 1"),
    (
        checklist_progress,
        """WITH l AS (SELECT l_orderkey obligation_id, l_linenumber, arg_max(l_linestatus = 'F', (l_shipdate, l_partkey, l_suppkey, l_quantity, l_linestatus)) c FROM lineitem GROUP BY 1, 2), s AS (SELECT obligation_id, count(*) items, count(*) FILTER (c) completed FROM l GROUP BY 1)
  SELECT *, round_even(completed / items::DOUBLE * 100, 1) percent, CASE WHEN completed = items THEN 'green' WHEN completed > 0 THEN 'yellow' ELSE 'red' END evidence_status FROM s""",
    ),
    (
        latest_evidence,
        PLAIN
        + ", e AS (SELECT l_orderkey, arg_max(CASE l_linestatus WHEN 'F' THEN 'green' ELSE 'yellow' END, (l_shipdate, l_partkey || '-' || l_suppkey || '-' || l_linenumber)) s FROM lineitem GROUP BY 1) SELECT obligation_id, coalesce(s, evidence_status) evidence_status FROM register LEFT JOIN e ON l_orderkey = obligation_id",
    ),
    (keyword_search, PLAIN + " SELECT obligation_id FROM register WHERE (title ILIKE '%urgent%' OR description ILIKE '%urgent%' OR len(list_filter(keywords, lambda k: contains(k, 'urgent'))) > 0) AND list_contains(intermediary_types, 'AF')"),
    (listing_page, PLAIN + ", m AS (SELECT obligation_id FROM register WHERE list_contains(intermediary_types, 'NO') AND severity = 'high' AND status = 'active') SELECT obligation_id, (SELECT count(*) FROM m) total FROM m ORDER BY 1 LIMIT 50 OFFSET 100"),
    (gaps_by_type, PLAIN + ", e AS (SELECT unnest(intermediary_types) intermediary_type, evidence_status FROM register) SELECT intermediary_type, count(*) obligations, count(*) FILTER (evidence_status <> 'green') gaps FROM e GROUP BY 1"),
    (
        dataset_profile,
        PLAIN
        + """ SELECT 'type' dimension, v "value", count(*) n FROM (SELECT unnest(intermediary_types) v FROM register) GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM register GROUP BY 2 UNION ALL SELECT 'party', responsible_party, count(*) FROM register GROUP BY 2
  UNION ALL SELECT 'circular', CAST(circular_id AS VARCHAR), count(*) FROM register GROUP BY 2 UNION ALL SELECT 'deadline_type', deadline_type, count(*) FROM register GROUP BY 2
  UNION ALL (SELECT 'keyword', v, count(*) n FROM (SELECT unnest(keywords) v FROM register) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 15) UNION ALL (SELECT 'evidence', v, count(*) n FROM (SELECT unnest(evidence_requirements) v FROM register) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)""",
    ),
    (
        dataset_shares,
        PLAIN + ", p AS (SELECT responsible_party r, count(*) n FROM register GROUP BY 1) SELECT count(*) total, count(*) FILTER (severity = 'high') / count(*)::DOUBLE high_share, count(*) FILTER (deadline_type = 'recurring') / count(*)::DOUBLE recurring_share, (SELECT arg_max(r, (n, r)) FROM p) busiest_party FROM register",
    ),
    (circular_list, PLAIN + " SELECT DISTINCT circular_id FROM register"),
    (not_applicable, PLAIN + " SELECT obligation_id FROM register WHERE NOT list_contains(intermediary_types, 'RF')"),
    (compliance_report, SCORES + " SELECT obligation_id, severity, evidence_status, risk_score FROM ranked WHERE list_contains(intermediary_types, 'RF')"),
    (template_procedures, PLAIN + " SELECT obligation_id, 6 steps, 'Step 5 — Review and approval: Submit evidence to ' || responsible_party || ' for sign-off before ' || deadline || '.' fifth FROM register"),
]
