"""Readers, writers and streams on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from statuta.operators import classify as CL
from statuta.operators import register as R
from statuta.sources import dataset as D
from statuta.sources import readers as RD
from statuta.sources import writers as W
from statuta.streaming import ingest as N


def test_json_and_csv(spark, tmp_path):
    row = {c: f"{c} 1" for c in RD.FLAT} | {"intermediary_types": "a; b ;", "evidence_requirements": "x;y", "keywords": "k"}
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"n": 1}, "obligations": [row, row]}))
    (tmp_path / "b.json").write_text(json.dumps([row]))
    assert RD.read_json_dataset(spark, f"{tmp_path}/a.json").count() == 2
    assert RD.read_json_dataset(spark, f"{tmp_path}/b.json").first()["title"] == "title 1"
    (tmp_path / "c.csv").write_text(",".join(RD.FLAT) + "\n" + ",".join(f'"{row[c]}"' for c in RD.FLAT) + "\n")
    flat = RD.normalised(RD.read_csv_dataset(spark, f"{tmp_path}/c.csv"))
    r = flat.first()
    assert r.intermediary_types == ["a", "b"] and r.evidence_requirements == ["x", "y"] and r.status == "active"
    assert {(x.dimension, x.value): x.n for x in D.profile(flat).collect()}["type", "b"] == 1
    W.export_with_envelope(flat, f"{tmp_path}/out", {"source": "test"})
    assert spark.read.json(f"{tmp_path}/out/metadata").first().total == 1


def test_text_files(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("é ok".encode())
    (tmp_path / "l.txt").write_bytes("é ok".encode("latin-1"))
    assert {r.text for r in RD.read_text_files(spark, f"{tmp_path}/*.txt").collect()} == {"é ok"}


def test_pages(spark):
    html = """<table><tr><td>1 Mar</td><td><a href="/c/1.html"><b>First</b> one</a></td></tr><tr><td>2 Mar</td><td><a href="javascript:x()">No</a></td></tr><tr><td>only</td></tr></table><iframe src="x.pdf"></iframe>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    r = RD.listing(df, "circular", base="https://h").collect()
    assert [(x.date, x.title, x.detail_url) for x in r] == [("1 Mar", "First one", "https://h/c/1.html")]
    assert [x.href for x in RD.links(df).collect()] == ["/c/1.html"]
    assert df.select(RD.attachment_url(F.col("html"), "nothing(x)", r'src="([^"]+)"').alias("u")).first().u == "x.pdf"


def test_tables(spark, tmp_path):
    p = f"{tmp_path}/g"
    nodes, edges = W.load_graph(spark, p, "obligation_id string")
    assert nodes.count() == edges.count() == 0
    W.save_graph(spark.createDataFrame([("a",)], "obligation_id string"), spark.createDataFrame([("a", "b", "related", 1.0)], "src string, dst string, edge_type string, weight double"), p)
    nodes, edges = W.load_graph(spark, p, "obligation_id string")
    assert nodes.count() == edges.count() == 1
    W.replace_table(nodes.unionByName(spark.createDataFrame([("c",)], "obligation_id string")), f"{p}/nodes")
    assert W.load_graph(spark, p, "obligation_id string")[0].count() == 2
    seen = spark.createDataFrame([("u1", "t", "d", "k", "c", None, dt.datetime(2026, 1, 1), False)], W.SEEN)
    more = spark.createDataFrame([("u2", "t", "d", "k", "c", None, dt.datetime(2026, 1, 2), False), ("u3", "t", "d", "k", "c", None, dt.datetime(2026, 1, 3), True)], W.SEEN)
    marked = W.mark_seen(seen, more)
    assert {r.detail_url for r in marked.collect()} == {"u1", "u2"}
    assert [r.detail_url for r in W.list_seen(marked).collect()] == ["u2", "u1"]
    h = W.list_seen(marked).first().url_hash
    assert {r.detail_url for r in W.remove_seen(marked, h).collect()} == {"u1"}


def test_ingestion_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    body = "1.1 Every stock broker shall submit the daily margin report to the exchange within 30 days. " * 2
    docs = [{"detail_url": f"u{i}", "circular_id": f"c{i}", "title": "T", "circular_type": "k", "date": "d", "document_text": body if i else "short"} for i in range(3)]
    for i, d in enumerate(docs):
        (src / f"{i}.json").write_text(json.dumps(d))
    keep = lambda df: CL.extract_obligations(df).select("obligation_id", "circular_id", "deadline", "severity")
    schema = "obligation_id string, circular_id string, deadline string, severity string"
    for _ in range(2):
        N.ingest(spark, str(src), f"{tmp_path}/reg", f"{tmp_path}/seen", f"{tmp_path}/cp", keep, schema, most_files=1).awaitTermination()
    N.ingest(spark, str(src), f"{tmp_path}/reg", f"{tmp_path}/seen", f"{tmp_path}/cp2", keep, schema).awaitTermination()
    batch = keep(spark.createDataFrame([(d["circular_id"], d["title"], d["document_text"]) for d in docs[1:]], "circular_id string, title string, document_text string"))
    got = spark.read.parquet(f"{tmp_path}/reg")
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert {r.detail_url for r in spark.read.parquet(f"{tmp_path}/seen").collect()} == {"u1", "u2"}


def test_audit_stream(spark, tmp_path):
    rows = [(i % 4, dt.datetime(2026, 1, 1, i % 4), "e") for i in range(8)]
    spark.createDataFrame(rows, "event_id int, timestamp timestamp, event_type string").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("event_id int, timestamp timestamp, event_type string").parquet(f"{tmp_path}/ev")
    N.append_stream(N.audit_stream(stream), f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == 4 and N.daily_counts(log).first().n == 4


def test_checklist_stream(spark, tmp_path):
    spark.createDataFrame([("o", "red")], "obligation_id string, evidence_status string").write.parquet(f"{tmp_path}/reg")
    batch = N.checklist_batch(f"{tmp_path}/reg", f"{tmp_path}/upd", "obligation_id string, evidence_status string")
    step = lambda done, ts: spark.createDataFrame([("o", "i1", True, ts), ("o", "i2", done, ts)], "obligation_id string, item_id string, completed boolean, ts int")
    batch(step(False, 1), 0)
    assert spark.read.parquet(f"{tmp_path}/reg").first().evidence_status == "yellow"
    batch(step(True, 2), 1)
    assert spark.read.parquet(f"{tmp_path}/reg").first().evidence_status == "green"


def test_classifier_end_to_end(spark, tmp_path):
    yes = ["Members shall submit the report within {n} days", "Brokers must maintain a register for {n} years", "The depository shall not charge more than {n} rupees"]
    no = ["The weather in town {n} was pleasant and calm", "Readers enjoyed chapter {n} of that long novel", "A red bicycle stood near house {n} yesterday"]
    templates = spark.createDataFrame([(f"y{i}", t, 1) for i, t in enumerate(yes)] + [(f"n{i}", t, 0) for i, t in enumerate(no)], "template_id string, text string, is_obligation int")
    rows = CL.expand_templates(templates, {"n": [str(x) for x in range(2, 40)]}, 12).withColumn("id", F.concat_ws("-", "template_id", "seed")).withColumn("doc_id", F.col("template_id"))
    split = CL.leak_free_split(rows, percent=50)
    assert split.groupBy("template_id").agg(F.countDistinct("held_out").alias("n")).filter("n > 1").count() == 0
    space = CL.fit_terms(rows, longest=2, characters=True, dense=True, most=500)
    data = CL.vectorize(rows.withColumn("label", F.col("is_obligation").cast("double")), space).cache()
    assert data.count() == 72
    model = CL.fit_head(data)
    scored = CL.classify_sentences(data, model, {}, 0.5)
    assert scored.filter("is_obligation = (label = 1)").count() == 72
    why = CL.explain(data.limit(3), model, space, k=6)
    assert why.groupBy("id").agg(F.max("rank").alias("m")).filter("m > 6").count() == 0 and why.count() > 0
    CL.save_bundle(f"{tmp_path}/bundle", space, {"obligation": model})
    again, heads, _ = CL.load_bundle(spark, f"{tmp_path}/bundle")
    assert again.size == space.size and heads["obligation"].coefficients == model.coefficients
    head, labels = CL.fit_labels(data.withColumn("severity", F.when(F.col("label") == 1, "high").otherwise("low")), "severity")
    assert labels == ["high", "low"]
    best = CL.best_label(head, labels, data, "severity")
    assert best.filter("severity = 'high' and label = 1").count() == 36
    assert set(CL.fit_one_vs_rest(data.withColumn("types", F.when(F.col("label") == 1, F.array(F.lit("a"), F.lit("all"))).otherwise(F.array(F.lit("all")))), ["a", "all", "none"], "types")) == {"a"}
    feats = CL.ModalityFeatures(inputCol="text", outputCol="f").transform(rows)
    assert len(feats.first()["f"]) == len(CL.DENSE) == 20


def test_extraction(spark):
    text = "1. DUTIES OF MEMBERS\n1.1 Every stock broker shall submit the daily margin report to the exchange within 30 days.\n1.2 The weather in the city has been pleasant for most of the time.\n"
    docs = spark.createDataFrame([("c1", "Circular", text)], "circular_id string, title string, document_text string")
    r = CL.extract_obligations(docs, requested=["stockbroker", "rta"]).collect()
    assert len(r) == 1
    o = r[0]
    assert (o.obligation_id, o.deadline, o.deadline_type, o.severity, o.intermediary_types) == ("c1_obl_0", "within 30 days", "relative", "high", ["stockbroker"])
    assert o.clause_reference.startswith("Clause 1.1 — 1. DUTIES OF MEMBERS") and o.evidence_checklist[0].item_id == "chk_0"
    scored = CL.rule_scores(__import__("statuta.operators.text", fromlist=["x"]).units(docs))
    assert CL.borderline(scored, threshold=0.95, least=0.05).count() == 2


def test_recognition(spark):
    w = spark.createDataFrame([("d", 0.9, {"kyc": 0.8, "risk": 0.2}), ("d", 0.7, {"kyc": 0.6, "risk": 0.4}), ("e", 0.1, {"kyc": 0.5, "risk": 0.5})], "circular_id string, circular_probability double, family_scores map<string,double>")
    near = spark.createDataFrame([("d", 0.85), ("e", 0.2)], "id string, similarity double")
    got = {r.circular_id: r for r in CL.recognise(w, near).collect()}
    assert got["d"].is_circular and not got["d"].is_novel_topic and got["d"].family == "kyc" and "kyc" in got["d"].verdict
    assert not got["e"].is_circular and got["e"].verdict.startswith("Not recognised")


def test_labelled_sentences(spark):
    clause = {"number": "1", "text": "Members shall file reports. They must keep records.", "is_obligation": True, "category": "c", "severity": "high", "deadline_type": "fixed", "template_id": "t1"}
    spec = [("d1", "fam", [([clause],)], ["A preamble line stands here."], [], [])]
    schema = "circular_id string, family string, sections array<struct<clauses:array<struct<number:string,text:string,is_obligation:boolean,category:string,severity:string,deadline_type:string,template_id:string>>>>, preamble array<string>, closing array<string>, addressees array<string>"
    df = spark.createDataFrame([(a, b, [([tuple(c[k] for k in ("number", "text", "is_obligation", "category", "severity", "deadline_type", "template_id"))],) for c in [clause]], p, q, r) for a, b, _, p, q, r in spec], schema)
    noise = spark.createDataFrame([(7, "noise line")], "line_no int, text string")
    rows = CL.labelled_sentences(df, noise).collect()
    assert sum(r.is_obligation for r in rows) == 2 and {r.doc_id for r in rows} == {"d1", "noise_2"}
    assert W.ground_truth(df).select(F.size("clauses").alias("n")).first().n == 1


def test_register_search(spark):
    reg = spark.createDataFrame([(1, "Margin", "d", ["Risk"], ["a"]), (2, "x", "y", ["z"], ["b"])], "obligation_id int, title string, description string, keywords array<string>, intermediary_types array<string>")
    assert [r.obligation_id for r in R.keyword_search(reg, "RISK").collect()] == [1] == [r.obligation_id for r in R.workflow_search(reg, "risk").collect()]
    vec = spark.createDataFrame([(1, 0.9), (2, 0.8)], "obligation_id int, similarity double")
    assert [r.obligation_id for r in R.search(reg, "x", "b", vec).collect()] == [2]


def test_reports(spark):
    from statuta.operators import graph as G
    from statuta.operators import reports as P

    schema = "obligation_id string, circular_id string, title string, description string, required_action string, clause_reference string, deadline string, deadline_type string, severity string, responsible_party string, intermediary_types array<string>, evidence_requirements array<string>, evidence_status string, status string, related_obligations array<string>, superseded_by array<string>"
    row = lambda i, text, sev, rel=(): (i, "c", f"T{i}", text, "act", "cl", None, "not_specified", sev, "P", ["a"], ["e"], "red", "active", list(rel), [])
    old = spark.createDataFrame([row("o1", "keep ledgers of margin collateral", "low")], schema)
    new = spark.createDataFrame([row("n1", "publish quarterly disclosure statements", "high", ["o1", "zz"])], schema)
    diff = P.diff_or_all_new(new, old)
    assert [r.change_class for r in diff.collect()] == ["NEW"]
    as_of = F.lit("2026-03-01").cast("date")
    reg, edges = P.commit(old, spark.createDataFrame([], "src string, dst string, edge_type string, weight double"), new, spark.createDataFrame([("o1", "n1")], "old_id string, new_id string"), as_of)
    got = {r.obligation_id: r for r in reg.collect()}
    assert got["o1"].status == "superseded" and got["o1"].superseded_by == ["n1"] and got["n1"].dependents == 2 and got["n1"].risk_score == 40 + 30 + 4
    spread = G.propagate(edges, spark.createDataFrame([("n1",)], "root string"))
    rep = P.change_report(diff, new, spread).first()
    assert (rep.new, rep.high_changes, rep.affected, rep.risk_level, rep.impact_band, rep.priority_ids) == (1, 1, 2, "high", "medium", ["n1"])
    assert [r.line for r in P.change_lines(diff, new.select(F.col("obligation_id").alias("new_id"), "title"), superseded=spark.createDataFrame([("o1",)], "old_id string")).collect()] == ["NEW: Tn1", "SUPERSEDED: o1"]
    parts = P.map_to_type(reg, "a", spark.createDataFrame([("o1",)], "obligation_id string"))
    assert parts["applicable"].count() == parts["not_applicable"].count() == parts["critical_gaps"].count() == 1
    said = spark.createDataFrame([("n1", "MODIFIED", "o1", ["x"])], "new_id string, change_class string, old_id string, changes array<string>")
    assert P.diff_or_all_new(new, old, said).first().change_class == "MODIFIED"


def test_analysis(spark):
    from statuta.operators import reports as P

    text = "1. DUTIES OF MEMBERS\n1.1 Every stock broker shall not delay the daily margin report to the exchange by March 31, 2026.\n1.2 Brokers shall maintain policies and registers at all times in the office.\n"
    parts = P.analyze(spark.createDataFrame([("c1", "Circular", text)], "circular_id string, title string, document_text string"), F.lit("2026-03-01").cast("date"))
    m = parts["summary_metrics"].first()
    assert (m.obligations_detected, m.with_deadline, m.without_deadline, m.prohibitions, m.high_severity) == (2, 1, 1, 1, 1)
    titles = [r.title for r in parts["findings"].orderBy("position").collect()]
    assert titles[:3] == ["2 obligations detected", "1 high-severity obligations", "1 obligations have no stated deadline"] and "Language profile" in titles
    assert parts["calendar"].first().days_remaining == 30 and len(parts["preview"].columns) == 12
    assert parts["document_profile"].first().sentences >= 2 and parts["distributions"].count() > 4 and parts["rejected"].count() == 0
