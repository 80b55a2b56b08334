"""Queries over fields, logs, exports, change reports and scores: lists of (name, query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import fields as X
from statuta.operators import changes as CH
from statuta.operators import evaluate as EV
from statuta.operators import graph as G
from statuta.operators import insights as I
from statuta.operators import register as R
from statuta.operators import reports as P
from statuta.operators import risk as K
from statuta.operators import similarity as S
from statuta.operators import text as T
from statuta.plans import views as V
from statuta.plans.register_queries import ACTS, PLAIN, SCORES, scored
from statuta.sources import readers as RD
from statuta.sources import writers as W


def confidence():  # noqa: ANN201
    """A confidence by the obligation's number."""
    return F.col("obligation_id") % 100 / 100.0


def top_by_severity_confidence(spark, d):
    return R.highest(V.register(spark, d).withColumn("confidence_score", confidence())).select("obligation_id", "severity", "confidence_score")


def workflow_search(spark, d):
    return R.workflow_search(V.register(spark, d), "RISK 1").select("obligation_id")


def search_with_matches(spark, d):
    """Vector matches joined to the register, and keyword search where there are none, as two parts."""
    reg = V.register(spark, d)
    matches = reg.select("obligation_id", confidence().alias("similarity")).filter("similarity >= 0.97")
    by_vector = R.search(reg, "any", "AF", matches).select(F.lit("vector").alias("path"), "obligation_id", "similarity")
    by_word = R.search(reg, "Order 77", None).select(F.lit("keyword").alias("path"), "obligation_id", F.lit(None).cast("double").alias("similarity"))
    return by_vector.unionByName(by_word)


def lookup(spark, d):
    reg = V.register(spark, d)
    return R.by_circular(reg, 7).select("obligation_id", "title").unionByName(R.by_id(reg, 64).select("obligation_id", "title"))


def explained_fields(spark, d):
    rows = V.register(spark, d).select("*", F.when(F.col("obligation_id") % 3 == 0, F.lit("")).otherwise(F.col("description")).alias("extraction_rationale"), confidence().alias("confidence_score"), F.lit("shall").alias("mandatory_keywords"))
    return R.explain_fields(rows).select("obligation_id", "rationale", "confidence_score")


def filtered_actions(spark, d):
    reg = scored(spark, d)
    return K.filtered(K.actions(reg), V.register(spark, d), "critical", "NO").select("obligation_id", "priority").distinct()


def _log(spark, d):
    kinds = {"purchase": "pipeline_completed"}
    kind = F.col("event_type")
    for a, b in kinds.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return V.table(spark, d, "events").select(
        "event_id", F.col("ts").alias("timestamp"), kind.alias("event_type"), F.col("user_id").cast("string").alias("circular_id"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status")
    )


def audit_tail(spark, d):
    return W.tail(_log(spark, d), 10, "event_id").select("event_id", "event_type", "status")


def audit_failures_of_circular(spark, d):
    return W.audit_trail(_log(spark, d), "13", "failure").select("event_id")


def daily_event_counts(spark, d):
    from statuta.streaming.ingest import daily_counts

    return daily_counts(_log(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")


def stream_register(spark, d):
    """The events as a stream of files, without repeats within the watermark, appended batch by batch and counted."""
    from statuta.session import scratch_path
    from statuta.streaming.ingest import append_stream, audit_stream

    out, checkpoint = scratch_path(spark, "events-out"), scratch_path(spark, "events-state")
    schema = V.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    append_stream(audit_stream(rows, "400 days"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))


def seen_registry(spark, d):
    pages = V.table(spark, d, "pages")
    entry = lambda rows, title: rows.select(F.col("url").alias("detail_url"), F.lit(title).alias("title"), (F.col("page_id") % 5 == 0).alias("dry_run"), F.timestamp_seconds("page_id").alias("processed_at"))
    first = entry(pages.groupBy("url").agg(F.min("page_id").alias("page_id")).filter("page_id % 2 = 0"), "old")
    later = entry(pages.groupBy("url").agg(F.min("page_id").alias("page_id")).filter("page_id % 3 = 0"), "new")
    return W.list_seen(W.mark_seen(first, later), 0, 1_000_000).select("detail_url", "title", "url_hash")


def graph_export(spark, d):
    nodes = G.export_nodes(V.register(spark, d)).select(F.lit("node").alias("part"), F.col("obligation_id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("severity").alias("label"), F.col("evidence_count").alias("n"))
    edges = G.export_edges(V.order_edges(spark, d)).select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_type").alias("label"), F.lit(None).cast("int").alias("n"))
    return nodes.unionByName(edges)


def edges_of_related(spark, d):
    """Edges from related ids, and how many ends are bare nodes."""
    related = V.register(spark, d).withColumn("related_obligations", F.array(F.col("obligation_id") + 1, F.col("obligation_id") + 1, F.col("obligation_id") + 2))
    edges = G.edges_from_related(related)
    bare = G.nodes_of(related, edges).join(related.select("obligation_id"), "obligation_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bare").alias("kind"), "n")
    return edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "n").unionByName(bare)


def impact_ratio(spark, d):
    roots = V.table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("root"))
    existing = V.table(spark, d, "orders").count()
    return G.impact_ratio(G.propagate_direct(V.order_edges(spark, d).join(roots, F.col("src") == F.col("root"), "left_semi")), existing).select("direct", "total", F.bround("impact_ratio", 6).alias("impact_ratio"))


def run_metrics(spark, d):
    runs = V.documents(spark, d).select(F.col("circular_id").alias("run_id"), "circular_id", F.length(F.coalesce("document_text", F.lit(""))).alias("chars"), (F.col("circular_id") % 41).cast("int").alias("obligations"), (F.col("circular_id") % 90 / 10.0).alias("seconds"))
    return W.run_metrics(runs).select("run_id", "pages", "obligations_per_page", "summary")


def ingestion_summary(spark, d):
    return W.ingestion_summary(V.table(spark, d, "events").select(F.when(F.col("event_type") == "error", "error").otherwise("ingested").alias("outcome")))


def slugs(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.slug(F.col("url")).alias("slug"))


def landed_records(spark, d):
    docs = V.table(spark, d, "documents").select(F.concat(F.col("source"), F.lit(" / Document No. "), F.col("doc_id").cast("string")).alias("name"), "text")
    return RD.landing_records(docs, F.col("name"), ["broker"]).select("circular_id", "length", F.array_join("intermediary_types", ",").alias("types"))


def absolute_links(spark, d):
    return RD.links(V.table(spark, d, "pages")).select("page_id", RD.absolute(F.col("href"), F.lit("https://a.example.org")).alias("url"))


def applies_to(spark, d):
    reg, none = V.register(spark, d), F.array().cast("array<string>")
    key = F.col("obligation_id")
    found = X.applies_to(F.when(key % 2 == 0, F.col("intermediary_types")).otherwise(none), F.when(key % 3 == 0, F.array(F.lit("RF"))).otherwise(none), F.when(key % 5 == 0, F.array(F.lit("AF"), F.lit("NO"))).otherwise(none))
    return reg.select("obligation_id", F.array_join(found, ",").alias("types"))


def evidence_checklist(spark, d):
    items = V.register(spark, d).select("obligation_id", F.explode(X.checklist(F.col("evidence_requirements"))).alias("i"))
    return items.select("obligation_id", "i.item_id", "i.label", "i.completed")


def adopted_types(spark, d):
    found = F.when(F.col("obligation_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("deadline"))
    model = F.when(F.col("obligation_id") % 2 == 0, "recurring").otherwise("unknown")
    return V.register(spark, d).select("obligation_id", X.adopt_type(found, F.lit("not_specified"), model).alias("deadline_type"))


def clause_references(spark, d):
    number = F.when(F.col("obligation_id") % 2 == 0, F.lit("4.2")).otherwise(F.lit(""))
    return V.register(spark, d).select("obligation_id", X.clause_reference(number, F.lit("General"), F.lit("Notice"), F.col("description")).alias("reference"))


SENTENCES = (
    "Every stock broker shall submit the report within {n} days of the event.",
    "The company must maintain a register on a quarterly basis, reference {n}.",
    "Members may file the statement by March 5, 19{n} at the office.",
    "The weather in town {n} was calm.",
)


def _sentences(spark, d):
    """One sentence an order, of four forms, with a number of its own."""
    n = (F.col("o_orderkey") % 90 + 10).cast("string")
    forms = [X.filled(s, {"n": n}) for s in SENTENCES]
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("s"))


def sentence_fields(spark, d):
    rows = _sentences(spark, d).withColumn("d", X.deadline(F.col("s")))
    return rows.select("id", "d.deadline", "d.deadline_type", F.array_join(X.named_types(F.col("s")), ",").alias("types"), F.array_join(X.mandatory_terms(F.col("s")), ",").alias("terms"), X.severity(F.col("s"), F.col("d.deadline_type"))["severity"].alias("severity"))


def modality_flags(spark, d):
    f = X.modality_features(F.col("s"))
    names = ("has_deontic", "has_prohibition", "has_discretion", "names_party", "has_timeline", "has_evidence_noun")
    return _sentences(spark, d).select("id", *[f[n].cast("int").alias(n) for n in names])


def trigger_rows(spark, d):
    t = X.trigger_confidence(F.col("s"), F.lit("act"), F.lit("response"))
    return _sentences(spark, d).select("id", t["confidence"].alias("confidence"), F.array_join(t["triggers"], ",").alias("triggers"))


def decoded_responses(spark, d):
    """Obligations of response texts: a whole array, one in a fence, one that breaks off, one without any."""
    obj = F.concat(F.lit('{"description": "D'), F.col("o_orderkey").cast("string"), F.lit(' shall file", "evidence_requirements": ["e1", "e2"]}'))
    two = F.concat(F.lit("["), obj, F.lit(", "), obj, F.lit("]"))
    kind = F.col("o_orderkey") % 4
    raw = F.when(kind == 0, two).when(kind == 1, F.concat(F.lit("```json\n"), two, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("["), obj, F.lit(', {"description": "cut'))).otherwise(F.lit("no answer"))
    decoded = CH.decode_responses(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), raw.alias("raw")), "struct<description:string,required_action:string,evidence_requirements:array<string>>")
    return CH.response_obligations(decoded).select("chunk_id", "pos", "description", "confidence", F.size("evidence_checklist").alias("items"))


def related_of_responses(spark, d):
    raw = V.table(spark, d, "nation").select(F.to_json(F.create_map(F.col("n_nationkey").cast("string"), F.array(F.col("n_regionkey").cast("string"), F.lit("x")))).alias("relations"))
    nations = V.table(spark, d, "customer").select(F.col("c_custkey"), (F.col("c_nationkey") + F.col("c_custkey") % 2 * 20).cast("string").alias("obligation_id"))
    return CH.relationships(raw, nations).select("c_custkey", F.array_join("related_obligations", ",").alias("related"))


def response_classes(spark, d):
    """A diff from response tables: rows that no response names are unchanged."""
    new = V.register(spark, d).filter("obligation_id % 7 = 0").select("obligation_id")
    key = F.col("obligation_id").cast("string")
    classes = new.filter("obligation_id % 2 = 0").select(key.alias("new_id"), F.when(F.col("obligation_id") % 3 == 0, "UNCHANGED").otherwise("MODIFIED").alias("change_class"), F.lit("o1").alias("old_id"), F.array(F.lit("text")).alias("changes"))
    return CH.diff_from_responses(new, classes).groupBy("change_class").agg(F.count(F.lit(1)).alias("n"))


def change_report(spark, d):
    reg = V.register(spark, d).filter("obligation_id % 5 = 0")
    diff = reg.select(F.col("obligation_id").cast("string").alias("new_id"), F.lit("o").alias("old_id"), F.when(F.col("obligation_id") % 2 == 0, "NEW").when(F.col("obligation_id") % 3 == 0, "MODIFIED").otherwise("UNCHANGED").alias("change_class"))
    spread = G.propagate_direct(V.order_edges(spark, d).filter("src % 5 = 0"))
    return P.change_report(diff, reg, spread).select("new", "modified", "unchanged", "high_changes", "affected", "risk_level", "impact_band", F.bround("impact_score", 3).alias("impact_score"), F.size("priority_ids").alias("first_ids"))


def extraction_scores(spark, d):
    """Documents as predictions against benchmark items of the same number, per document group and as means."""
    group = lambda c: (F.col(c) % 10).alias("doc")
    predictions = V.table(spark, d, "documents").select(group("doc_id"), F.col("doc_id").alias("id"), F.col("text"), F.when(F.length("text") > 2000, "high").otherwise("low").alias("severity"))
    truth = V.table(spark, d, "benchmark").select(group("item_id"), F.col("item_id").alias("id"), "text", F.lit("low").alias("severity"))
    return EV.extraction_scores(predictions, truth).select("doc", "predicted", "true", F.bround("precision", 6).alias("precision"), F.bround("recall", 6).alias("recall"), F.bround("f1", 6).alias("f1"), F.bround("severity_agreement", 6).alias("severity_agreement"))


def summary_metrics(spark, d):
    # in 64ths, whose sums are exact in any order
    reg = V.register(spark, d).withColumn("confidence_score", F.col("obligation_id") % 64 / 64.0)
    profiles = V.table(spark, d, "customer").select(F.col("c_custkey").alias("circular_id"), (F.col("c_custkey") % 30).cast("int").alias("sentences"))
    return I.summary_metrics(reg, profiles, prohibitions=("urgent",)).select("circular_id", "obligations_detected", "high_severity", "with_deadline", "recurring_obligations", "prohibitions", "distinct_owners", "mean_confidence", "obligation_density_pct")


def section_mandatory_top(spark, d):
    units = V.turns(spark, d).select("circular_id", F.concat(F.col("role"), F.lit(" "), (F.col("id") % 3).cast("string")).alias("section"), F.coalesce("text", F.lit("")).alias("sentence"), F.col("id").alias("order"))
    return I.top_sections(I.section_profile(units, markers=("the", "that")), 2).select("circular_id", "section", "sentences", "mandatory_sentences", "rank")


def vector_ingestion(spark, d):
    """Each tenth vector comes anew, halved, with a number beyond those known; one vector a key stays."""
    old = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    new = old.filter("vec_id % 10 = 0").select("vec_id", (F.col("x") / 2).alias("x")).unionByName(old.filter("vec_id % 25 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id"), "x"))
    return S.ingest_vectors(old, new).select("vec_id", F.bround("x", 6).alias("x"))


def clause_numbers(spark, d):
    n = F.col("o_orderkey")
    lead = F.when(n % 4 == 0, F.concat((n % 9 + 1).cast("string"), F.lit(".2 "))).when(n % 4 == 1, F.lit("(a) ")).otherwise(F.lit(""))
    s = F.concat(lead, F.lit("Members shall file the report."))
    return V.table(spark, d, "orders").select("o_orderkey", T.clause_number(s).alias("number"), T.without_clause_number(s).alias("rest"))


def evidence_upload_counts(spark, d):
    from statuta.operators.evidence import counts

    index = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("obligation_id"), F.col("l_linenumber").alias("filename"))
    return counts(index)

FORM = "CASE o_orderkey % 4"
N = "CAST(o_orderkey % 90 + 10 AS VARCHAR)"

QUERIES = [
    (top_by_severity_confidence, PLAIN + " SELECT obligation_id, severity, (obligation_id % 100) / 100.0::DOUBLE confidence_score FROM register ORDER BY CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, confidence_score DESC, obligation_id LIMIT 25"),
    (workflow_search, PLAIN + " SELECT obligation_id FROM register WHERE len(list_filter(keywords, lambda k: contains(lower(k), 'risk 1'))) > 0"),
    (
        search_with_matches,
        PLAIN
        + " SELECT 'vector' AS path, obligation_id, (obligation_id % 100) / 100.0::DOUBLE similarity FROM register WHERE (obligation_id % 100) / 100.0::DOUBLE >= 0.97::DOUBLE AND list_contains(intermediary_types, 'AF') UNION ALL SELECT 'keyword', obligation_id, NULL FROM register WHERE contains(lower(title), 'order 77') OR contains(lower(description), 'order 77')",
    ),
    (lookup, PLAIN + " SELECT obligation_id, title FROM register WHERE circular_id = 7 UNION ALL SELECT obligation_id, title FROM register WHERE obligation_id = 64"),
    (explained_fields, PLAIN + " SELECT obligation_id, CASE WHEN obligation_id % 3 = 0 THEN 'No rationale recorded.' ELSE description END rationale, (obligation_id % 100) / 100.0::DOUBLE confidence_score FROM register"),
    (filtered_actions, ACTS + " SELECT obligation_id, priority FROM acts WHERE priority = 'critical' AND list_contains(intermediary_types, 'NO')"),
    (audit_tail, "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'pipeline_completed' ELSE event_type END event_type, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END status FROM events ORDER BY event_id DESC LIMIT 10"),
    (audit_failures_of_circular, "SELECT event_id FROM events WHERE user_id = 13 AND event_type = 'error'"),
    (daily_event_counts, "SELECT strftime(ts, '%Y-%m-%d') AS \"day\", CASE event_type WHEN 'purchase' THEN 'pipeline_completed' ELSE event_type END event_type, count(*) n FROM events GROUP BY 1, 2"),
    (stream_register, "SELECT event_type, count(DISTINCT event_id) n, count(DISTINCT event_id) events FROM events GROUP BY 1"),
    (
        seen_registry,
        "WITH u AS (SELECT url, min(page_id) p FROM pages GROUP BY 1), n AS (SELECT url, p FROM u WHERE p % 3 = 0 AND p % 5 <> 0) SELECT url detail_url, 'new' AS title, md5(url)[1:8] url_hash FROM n UNION ALL SELECT url, 'old', md5(url)[1:8] FROM u WHERE p % 2 = 0 AND url NOT IN (SELECT url FROM n)",
    ),
    (graph_export, PLAIN + ", " + V.ORDER_EDGES + " SELECT 'node' AS part, obligation_id a, NULL::BIGINT b, severity AS \"label\", CAST(len(evidence_requirements) AS INTEGER) n FROM register UNION ALL SELECT 'edge', src, dst, 'related', NULL FROM order_edges"),
    (
        edges_of_related,
        "WITH e AS (SELECT DISTINCT o_orderkey src, o_orderkey + i dst FROM orders, (VALUES (1), (2)) v(i)), b AS (SELECT DISTINCT dst FROM e WHERE dst NOT IN (SELECT o_orderkey FROM orders)) SELECT 'edges' AS kind, (SELECT count(*) FROM e) n UNION ALL SELECT 'bare', (SELECT count(*) FROM b)",
    ),
    (
        impact_ratio,
        "WITH " + V.ORDER_EDGES + ", n AS (SELECT count(DISTINCT dst) n FROM order_edges WHERE src % 50 = 0) SELECT n direct, n total, round_even(least(n / (SELECT count(*) FROM orders)::DOUBLE, 1.0), 6) impact_ratio FROM n",
    ),
    (
        run_metrics,
        "SELECT doc_id run_id, CAST(greatest(1, length(coalesce(text, '')) // 3000) AS INTEGER) pages, round_even((doc_id % 41) / CAST(greatest(1, length(coalesce(text, '')) // 3000) AS DOUBLE), 2) obligations_per_page, (doc_id % 41) || ' obligations from ' || length(coalesce(text, '')) || ' characters in ' || printf('%.1f', (doc_id % 90) / 10.0::DOUBLE) || ' s' AS summary FROM documents",
    ),
    (ingestion_summary, "SELECT count(*) FILTER (event_type <> 'error') ingested, count(*) FILTER (event_type = 'error') errors, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'partial' ELSE 'failed' END status FROM events"),
    (slugs, "SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_')[1:60] slug FROM pages"),
    (landed_records, "SELECT trim(regexp_replace(lower(source || ' / Document No. ' || doc_id), '[^a-z0-9]+', '_', 'g'), '_')[1:60] circular_id, CAST(length(text) AS INTEGER) \"length\", 'broker' AS types FROM documents"),
    (
        absolute_links,
        r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) a FROM pages),
  l AS (SELECT page_id, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) h, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) t FROM a)
  SELECT page_id, CASE WHEN regexp_matches(h, '^https?:') THEN h WHEN starts_with(h, '/') THEN 'https://a.example.org' || h ELSE 'https://a.example.org/' || h END url FROM l WHERE h <> '' AND t <> '' AND NOT regexp_matches(lower(h), '^javascript:')""",
    ),
    (
        applies_to,
        PLAIN
        + """, f AS (SELECT obligation_id, CASE WHEN obligation_id % 2 = 0 AND len(intermediary_types) > 0 THEN intermediary_types WHEN obligation_id % 3 = 0 THEN ['RF'] WHEN obligation_id % 5 = 0 THEN ['AF', 'NO'] ELSE ['stockbroker'] END f, obligation_id % 5 = 0 asked FROM register)
  SELECT obligation_id, array_to_string(CASE WHEN NOT asked THEN f WHEN len(list_filter(f, lambda x: x IN ('AF', 'NO'))) > 0 THEN list_sort(list_filter(f, lambda x: x IN ('AF', 'NO'))) ELSE ['AF', 'NO'] END, ',') types FROM f""",
    ),
    (evidence_checklist, PLAIN + " SELECT obligation_id, 'chk_' || i AS item_id, evidence_requirements[i + 1] AS \"label\", false completed FROM register, (VALUES (0), (1)) v(i)"),
    (adopted_types, "SELECT o_orderkey obligation_id, CASE WHEN o_orderkey % 6 = 0 THEN 'recurring' ELSE 'not_specified' END deadline_type FROM orders"),
    (clause_references, PLAIN + """ SELECT obligation_id, CASE WHEN obligation_id % 2 = 0 THEN 'Clause 4.2' ELSE 'Notice' END || ' — General: "' || description[1:180] || '"' AS reference FROM register"""),
    (
        sentence_fields,
        f"""SELECT o_orderkey id, {FORM} WHEN 0 THEN 'within ' || {N} || ' days' WHEN 1 THEN 'on a quarterly basis' WHEN 2 THEN 'March 5, 19' || {N} END deadline, {FORM} WHEN 0 THEN 'relative' WHEN 1 THEN 'recurring' WHEN 2 THEN 'fixed' ELSE 'not_specified' END deadline_type,
  {FORM} WHEN 0 THEN 'stockbroker' ELSE '' END types, {FORM} WHEN 0 THEN 'shall' WHEN 1 THEN 'must,maintain' ELSE '' END terms, 'medium' AS severity FROM orders""",
    ),
    (
        modality_flags,
        f"SELECT o_orderkey id, {FORM} WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END has_deontic, 0 has_prohibition, {FORM} WHEN 2 THEN 1 ELSE 0 END has_discretion, {FORM} WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END names_party, {FORM} WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END has_timeline, {FORM} WHEN 3 THEN 0 ELSE 1 END has_evidence_noun FROM orders",
    ),
    (trigger_rows, f"SELECT o_orderkey id, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END confidence, {FORM} WHEN 0 THEN 'shall' WHEN 1 THEN 'must,maintain' ELSE '' END triggers FROM orders"),
    (
        decoded_responses,
        "SELECT o_orderkey chunk_id, CAST(i AS INTEGER) pos, 'D' || o_orderkey || ' shall file' AS description, 0.95::DOUBLE confidence, 2 items FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderkey % 4 <> 3 AND (o_orderkey % 4 <> 2 OR i = 0)",
    ),
    (related_of_responses, "SELECT c_custkey, coalesce(n_regionkey || ',x', '') related FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + c_custkey % 2 * 20"),
    (response_classes, "SELECT CASE WHEN o_orderkey % 2 <> 0 OR o_orderkey % 3 = 0 THEN 'UNCHANGED' ELSE 'MODIFIED' END change_class, count(*) n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1"),
    (
        change_report,
        PLAIN
        + ", "
        + V.ORDER_EDGES
        + """, c AS (SELECT severity, CASE WHEN obligation_id % 2 = 0 THEN 'NEW' WHEN obligation_id % 3 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END k FROM register WHERE obligation_id % 5 = 0),
  t AS (SELECT count(*) FILTER (k = 'NEW') n, count(*) FILTER (k = 'MODIFIED') m, count(*) FILTER (k = 'UNCHANGED') u, count(*) FILTER (k <> 'UNCHANGED' AND severity = 'high') h, count(*) total FROM c), s AS (SELECT count(DISTINCT dst) a FROM order_edges WHERE src % 5 = 0)
  SELECT n "new", m modified, u unchanged, h high_changes, a affected, CASE WHEN h > 0 OR a > 20 THEN 'high' WHEN a > 10 THEN 'medium' ELSE 'low' END risk_level, CASE WHEN a > 5 THEN 'high' WHEN a > 0 THEN 'medium' ELSE 'none' END impact_band, round_even(least(1.0::DOUBLE, (n + 0.5::DOUBLE * m) / total), 3) impact_score, CAST(least(h, 10) AS INTEGER) first_ids FROM t, s""",
    ),
    (
        extraction_scores,
        """WITH q AS (SELECT item_id % 10 g, item_id t, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) w FROM benchmark), d AS (SELECT doc_id % 10 g, doc_id p, length(text) > 2000 big, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) w FROM documents),
  qe AS (SELECT g, t, len(w) n, unnest(w) x FROM q), de AS (SELECT g, p, len(w) n, unnest(w) x FROM d), s AS (SELECT g, p, t, count(*) / least(max(qe.n), max(de.n))::DOUBLE o FROM qe JOIN de USING (g, x) GROUP BY 1, 2, 3),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, p ORDER BY o DESC, t) k FROM s WHERE o >= 0.6) WHERE k = 1), h AS (SELECT r.g, count(DISTINCT r.p) hp, count(DISTINCT t) ht, avg(CASE WHEN big THEN 0.0 ELSE 1.0 END) a FROM r JOIN d USING (p) GROUP BY 1),
  c AS (SELECT g, (SELECT count(*) FROM d WHERE d.g = x.g) np, (SELECT count(*) FROM q WHERE q.g = x.g) nt FROM (SELECT DISTINCT g FROM d UNION SELECT DISTINCT g FROM q) x), m AS (SELECT c.g, np, nt, coalesce(hp, 0) / greatest(np, 1)::DOUBLE p, coalesce(ht, 0) / greatest(nt, 1)::DOUBLE r, a FROM c LEFT JOIN h USING (g))
  SELECT g doc, np predicted, nt "true", round_even(p, 6) "precision", round_even(r, 6) recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) f1, round_even(a, 6) severity_agreement FROM m""",
    ),
    (
        summary_metrics,
        PLAIN
        + """, c AS (SELECT circular_id, count(*) n, count(*) FILTER (severity = 'high') h, count(*) FILTER (coalesce(deadline, '') <> '') w, count(*) FILTER (deadline_type = 'recurring') r, count(*) FILTER (contains(lower(description), 'urgent')) p, count(DISTINCT responsible_party) o, round_even(avg((obligation_id % 64) / 64.0::DOUBLE), 3) m FROM register GROUP BY 1)
  SELECT c_custkey circular_id, coalesce(n, 0) obligations_detected, coalesce(h, 0) high_severity, coalesce(w, 0) with_deadline, coalesce(r, 0) recurring_obligations, coalesce(p, 0) prohibitions, coalesce(o, 0) distinct_owners, coalesce(m, 0) mean_confidence, round_even(coalesce(n, 0) / greatest(c_custkey % 30, 1)::DOUBLE * 100, 1) obligation_density_pct FROM customer LEFT JOIN c ON circular_id = c_custkey""",
    ),
    (
        section_mandatory_top,
        """WITH u AS (SELECT conv_id c, role || ' ' || (turn % 3) s, count(*) n, count(*) FILTER (contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(text, '')), 'that')) m, min(turn) f FROM conversations GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, f, s) k FROM u) SELECT c circular_id, s section, n sentences, m mandatory_sentences, k "rank" FROM r WHERE k <= 2""",
    ),
    (
        vector_ingestion,
        "SELECT vec_id, round_even(CASE WHEN vec_id % 10 = 0 THEN embedding[1]::DOUBLE / 2 ELSE embedding[1]::DOUBLE END, 6) x FROM embeddings UNION ALL SELECT vec_id + 10000000, round_even(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 25 = 0",
    ),
    (clause_numbers, "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 9 + 1) || '.2' WHEN 1 THEN '(a' ELSE '' END \"number\", 'Members shall file the report.' AS rest FROM orders"),
    (evidence_upload_counts, "SELECT l_orderkey obligation_id, count(*) documents FROM lineitem GROUP BY 1"),
]
