"""Hand-worked cases of text, fields, risk, changes, graph, evidence and responses."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta.functions import fields as X
from statuta.functions import lexicon as L
from statuta.operators import changes as CH
from statuta.operators import evidence as E
from statuta.operators import graph as G
from statuta.operators import insights as I
from statuta.operators import register as R
from statuta.operators import risk as K
from statuta.operators import similarity as S
from statuta.operators import text as T

def as_of():
    return F.lit("2026-03-01").cast("date")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,deadline,kind,days",
    [
        ("file within 30 days of it", "within 30 days", "relative", 30),
        ("within forty-five days", "within forty-five days", "relative", None),
        ("within 24 hours of it", "within 24 hours", "relative", None),
        ("on a quarterly basis", "on a quarterly basis", "recurring", 90),
        ("a half-yearly report", "half-yearly", "recurring", 365),
        ("report weekly", "weekly", "recurring", 30),
        ("by March 31, 2026", "March 31, 2026", "fixed", None),
        ("by 31 March 2026", None, "not_specified", None),
        ("on 2026-03-31", "2026-03-31", "fixed", 30),
        ("nothing here", None, "not_specified", None),
        ("within 10 WORKING Days", "within 10 working days", "relative", 10),
    ],
)
def test_deadlines(spark, text, deadline, kind, days):
    df = spark.createDataFrame([(text,)], ["s"]).select(X.deadline(F.col("s")).alias("d")).select("d.*")
    row = df.withColumn("n", X.days_remaining(F.col("deadline"), F.col("deadline_type"), as_of())).first()
    assert (row.deadline, row.deadline_type, row.n) == (deadline, kind, days)


@pytest.mark.parametrize("text,days", [("March 31, 2026", 30), ("1/3/2026", 0), ("31 March 2026", 30), ("2026-3-5", 4), ("march 31 2026", 30), ("soon", None)])
def test_written_dates(spark, text, days):
    assert one(spark, X.days_until(F.lit(text), as_of())) == days


@pytest.mark.parametrize(
    "severity,evidence,days,n,score,label",
    [("high", "red", -1, 6, 100, "High"), ("medium", "yellow", 30, 1, 47, "Medium"), ("medium", "green", 30, 0, 30, "Low"), ("high", "yellow", 30, 0, 65, "Medium"), ("high", "yellow", 30, 1, 67, "High"), ("low", "green", None, 0, 5, "Low"), ("critical", "red", None, 0, 50, "Medium")],
)
def test_risk(spark, severity, evidence, days, n, score, label):
    s = X.risk_score(F.lit(severity), F.lit(evidence), F.lit(days).cast("int"), F.lit(n))
    assert one(spark, F.struct(s.alias("s"), X.risk_label(s).alias("l"))) == (score, label)


def test_orders_of_days(spark):
    rows = spark.createDataFrame([(1, 5, 50.0), (2, 0, 50.0), (3, None, 50.0), (4, -2, 50.0)], "obligation_id int, days_remaining int, risk_score double")
    assert [r.obligation_id for r in K.urgency_queue(rows).collect()] == [4, 1, 2, 3]
    acts = rows.withColumn("priority", F.lit("high"))
    assert [r.obligation_id for r in K.in_order(acts).collect()] == [4, 2, 1, 3]


def test_compliance_score(spark):
    rows = spark.createDataFrame([(["a"], "high", "green"), (["a"], "medium", "yellow"), (["a"], "low", "red")], "intermediary_types array<string>, severity string, evidence_status string")
    got = {r.intermediary_type: r.score for r in R.compliance_scores(rows, ["a", "b"]).collect()}
    assert got == {"a": 66.7, "b": 100.0}
    assert R.overall_score(R.compliance_scores(rows, ["a", "b"])).first().overall == pytest.approx(83.35, abs=0.1)


EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "related", 1.0) for a, b in pairs], "src string, dst string, edge_type string, weight double")


def test_graph(spark):
    e = edges_of(spark, EDGES)
    roots = lambda *r: spark.createDataFrame([(x,) for x in r], "root string")
    spread = {(r.node, r.kind) for r in G.propagate(e, roots("a")).collect()}
    assert spread == {("b", "direct"), ("c", "indirect"), ("d", "indirect")}
    assert G.impact_totals(G.propagate(e, roots("a", "b"))).first().total == 4
    assert {(r.node, r.hop) for r in G.upstream(e, roots("d"), 2).collect()} == {("c", 0), ("b", 1)}
    nodes = spark.createDataFrame([(x,) for x in "abcdx"], "obligation_id string")
    d = G.density(nodes, e).first()
    assert (d.avg_degree, d.density) == (1.6, 0.8)
    assert G.longest_path(e) == 3 and G.is_acyclic(e)
    b = {r.obligation_id: r.betweenness for r in G.betweenness(nodes, e).collect()}
    assert b["b"] == pytest.approx(4 / 12) and b["c"] == pytest.approx(3 / 12) and b["a"] == b["d"] == b["x"] == 0
    loop = edges_of(spark, [("a", "b"), ("b", "a")])
    assert {r.node for r in G.reachable(loop, roots("a")).collect()} == {"a", "b"}
    assert G.longest_path(loop) == 0 and not G.is_acyclic(loop)
    card = {r.root: (r.n_dependents, r.n_dependencies, r.n_transitive) for r in G.cards(e, roots("b", "d")).collect()}
    assert card == {"b": (1, 2, 2), "d": (0, 1, 0)}
    assert G.impact_ratio(G.propagate(e, roots("a")), 0).first().impact_ratio == 1.0


def obligation(spark, rows):
    return spark.createDataFrame(rows, "obligation_id string, title string, description string, deadline string, deadline_type string, severity string, responsible_party string, intermediary_types array<string>, evidence_requirements array<string>")


def test_diff(spark):
    text = "brokers maintain segregated ledgers covering client margin collateral balances"
    old = obligation(spark, [("o1", "t", text, "within 30 days", "relative", "high", "X", ["a"], ["e"])])
    new = obligation(
        spark,
        [
            ("same", "t", text, "within 15 days", "relative", "high", "X", ["a"], ["e"]),
            ("mod", "t", text + " quarterly", "within 15 days", "relative", "high", "X", ["b"], ["e", "f"]),
            ("near", "t", text + " quarterly", "within 30 days", "relative", "high", "X", ["a"], ["e"]),
            ("new", "t", "unrelated wording about training programmes", None, None, "low", "X", ["a"], []),
        ],
    )
    got = {r.new_id: r for r in CH.lexical_diff(new, old).collect()}
    assert {k: r.change_class for k, r in got.items()} == {"same": "UNCHANGED", "mod": "MODIFIED", "near": "UNCHANGED", "new": "NEW"}
    assert got["same"].similarity >= 0.92 > got["mod"].similarity >= 0.62
    assert got["mod"].changes == ["deadline: 'within 30 days' → 'within 15 days'", "now also applies to: b", "no longer applies to: a", "new evidence required: f"]
    assert CH.impact_score(CH.lexical_diff(new, old)).first().impact_score == pytest.approx(0.375)
    everything = CH.lexical_diff(new, old.limit(0))
    assert everything.filter("change_class = 'NEW'").count() == 4 and CH.impact_score(everything).first().impact_score == 1.0
    again = CH.lexical_diff(new, new)
    assert again.filter("change_class <> 'UNCHANGED'").count() == 0


def test_claims(spark):
    got = CH.claim_once(spark.createDataFrame([(0, 0, 0.8), (1, 0, 0.9)], "a int, b int, similarity double")).collect()
    assert {r.a: r.claimed for r in got} == {0: True, 1: False}


def test_merge(spark):
    schema = "circular_id string, order int, title string, description string, required_action string, responsible_party string, deadline string, deadline_type string, evidence_requirements array<string>, keywords array<string>, confidence_score double"
    a = "submit quarterly margin report to exchange"
    local = spark.createDataFrame([("c", 0, "t0", a, "act", "p", None, "not_specified", ["x"], ["k"], 0.9), ("c", 1, "t1", "appoint compliance officer promptly", "act", "p", None, None, [], [], 0.7)], schema)
    resp = spark.createDataFrame([("c", 0, "better", a, "", "q", "within 5 days", "relative", ["y"], [], 0.95), ("c", 1, "second", a, "", "q", None, None, [], [], 0.95), ("c", 2, "own", "publish website disclosure", "", "r", None, None, [], [], 0.7)], schema)
    rows = {r.obligation_id: r for r in CH.merge_sets(local, resp).collect()}
    assert sorted(rows) == ["c_obl_0", "c_obl_1", "c_obl_2", "c_obl_3"]
    m = rows["c_obl_0"]
    assert (m.title, m.required_action, m.responsible_party, m.deadline, m.deadline_type, m.evidence_requirements, m.confidence_score, m.confirmed) == ("better", "act", "q", "within 5 days", "relative", ["x", "y"], 0.95, True)
    assert rows["c_obl_1"].title == "t1" and {rows["c_obl_2"].title, rows["c_obl_3"].title} == {"second", "own"}


DOC = """Page 1 of 2
Ref: SEBI/HO/CIR/2026/55
To, All Members
1. REPORTING DUTIES
1.1 Every stock broker shall submit the daily margin report within 4.2
working days. The report must carry mark-
ings by Dr. Rao; it shall be kept. ok

GENERAL MATTERS
The Board may consider awareness programmes as far as possible in this regard.
(a) Records shall be pre-
served for five years.
"""


def test_text(spark):
    df = spark.createDataFrame([("d", DOC), ("e", None), ("f", "")], "circular_id string, document_text string")
    clean = df.select("circular_id", T.clean_text(F.col("document_text")).alias("t")).collect()
    assert "Page 1" not in clean[0].t and "markings" in clean[0].t and clean[1].t == "" and "preserved" in clean[0].t
    blocks = [(r.kind, r.text) for r in T.blocks(df).orderBy("block_no").collect()]
    assert ("heading", "GENERAL MATTERS") in blocks and ("heading", "1. REPORTING DUTIES") in blocks
    clause = next(t for k, t in blocks if k == "clause" and t.startswith("1.1"))
    assert clause == "1.1 Every stock broker shall submit the daily margin report within 4.2 working days. The report must carry markings by Dr. Rao; it shall be kept. ok"
    units = T.units(df).orderBy("order").collect()
    assert [u.order for u in units] == list(range(1, len(units) + 1))
    by = {u.sentence: (u.section, u.clause_number) for u in units}
    assert by["Every stock broker shall submit the daily margin report within 4.2 working days. The report must carry markings by Dr."] == ("1. REPORTING DUTIES", "1.1")
    assert by["Rao;"] == by["it shall be kept."] == ("1. REPORTING DUTIES", "1.1")
    assert by["Records shall be preserved for five years."] == ("GENERAL MATTERS", "(a")
    assert not any(s.strip() == "ok" for s in by)
    assert by["Ref: SEBI/HO/CIR/2026/55"] == ("General", "")


def test_abbreviations_go_to_the_sentence_before(spark):
    got = one(spark, T.split_sentences(F.lit("This is so. See the para. No. 4 applies here. Yes; we do.")))
    assert got == ["This is so. See the para. No.", "4 applies here.", "Yes;", "we do."]


@pytest.mark.parametrize("text,number,rest", [("1.2 The member", "1.2", "The member"), ("(a) The member", "(a", "The member"), ("(iv) x", "(iv", "x"), ("The member", "", "The member")])
def test_clause_numbers(spark, text, number, rest):
    assert one(spark, F.array(T.clause_number(F.lit(text)), T.without_clause_number(F.lit(text)))) == [number, rest]


@pytest.mark.parametrize("text,is_it", [("too short", True), ("Yours faithfully and with many regards to you", True), ("Annexure A lists the formats used", True), ("12/34/56 78-90 1234567890 1234567890", True), ("The broker shall keep all records for five years", False)])
def test_boilerplate(spark, text, is_it):
    assert one(spark, T.is_boilerplate(F.lit(text))) is is_it


@pytest.mark.parametrize("n,count", [(1200, 1), (1300, 2), (1500, 2), (0, 0), (100, 1)])
def test_windows(spark, n, count):
    assert T.windows(spark.createDataFrame([("d", "x" * n)], "circular_id string, document_text string")).count() == count


def test_passages(spark):
    body = "\n\n".join(["A" + "b" * 300 + f" {i}." for i in range(5)])
    df = spark.createDataFrame([("d", "FIRST SECTION HERE\n" + body)], "circular_id string, document_text string")
    rows = T.passages(df).orderBy("place").collect()
    assert [r.passage_id for r in rows] == ["p000", "p001", "p002"] and {r.section for r in rows} == {"FIRST SECTION HERE"} and all(len(r.text) <= 910 for r in rows)
    obl = spark.createDataFrame([("d", "o1", "T", "D.", "P", None, "high", "Clause 1", ["e"])], "circular_id string, obligation_id string, title string, description string, responsible_party string, deadline string, severity string, clause_reference string, evidence_requirements array<string>")
    assert T.obligation_passages(obl, T.passages(df)).first().passage_id == "o003"


def test_metadata(spark):
    texts = [
        "NOTICE\nOur ref ab-1234, of today\nSubject:  Filing of reports \nbody",  # reference and subject line
        "FIRST LINE THAT IS LONG ENOUGH\nA line of more than twenty characters\nrest",  # the first that is not all capitals
        "short\nsecond\nthird", "one", "", None, "\n".join(["x"] * 15 + ["CD-99"] + ["y"] * 12 + ["Re: too late"]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "circular_id int, document_text string")
    got = {r.circular_id: (r.reference, r.slug, r.subject) for r in T.metadata(df, reference=r"\b[A-Z]{2,5}-\d{2,6}\b").collect()}
    assert got[0] == ("ab-1234", "ab_1234", "Filing of reports") and got[1] == (None, None, "A line of more than twenty characters")
    assert got[2] == (None, None, "second") and got[3] == got[4] == got[5] == (None, None, None) and got[6] == (None, None, "x")


def test_chunks(spark):
    text = "1.1 First Heading Text\n" + "body line\n" * 40 + "PART II\n" + "more\n" * 3
    rows = T.chunks(spark.createDataFrame([("d", text)], "circular_id string, document_text string")).orderBy("chunk_no").collect()
    assert len(rows) == 2 and rows[1].section_hint == "PART II" and rows[1].text.startswith("PART II")


def test_keyword_profile(spark):
    df = spark.createDataFrame([("d", "risk margin risk margin risk margin")], "circular_id string, document_text string")
    assert [(r.term, r["count"]) for r in I.keyword_profile(df).orderBy("rank").collect()] == [("risk margin", 6), ("risk", 3), ("margin", 3)]


def test_evidence(spark):
    reg = spark.createDataFrame([("o", ["alpha beta gamma delta", "nothing there"])], "obligation_id string, evidence_requirements array<string>")
    docs = spark.createDataFrame([("o", "f.txt", "alpha and BETA")], "obligation_id string, filename string, text string")
    assert [(r.score, r.satisfied) for r in E.match(docs, reg).orderBy("position").collect()] == [(0.5, True), (0.0, False)]
    r = E.roll_up(E.match(docs, reg)).first()
    assert (r.overall_score, r.evidence_status, r.matched, r.unmatched) == (0.5, "yellow", ["alpha beta gamma delta"], ["nothing there"])
    for done, want in ((2, (66.7, "yellow")), (0, (0.0, "red")), (3, (100.0, "green"))):
        items = F.array(*[F.struct(F.lit(i < done).alias("completed")) for i in range(3)])
        assert tuple(one(spark, E.progress(items))) == want
    assert [one(spark, X.evidence_status(F.lit(x))) for x in (0.8, 1 / 3, 0.4)] == ["green", "red", "yellow"]


@pytest.mark.parametrize(
    "text,kind,model,confidence,severity",
    [
        ("Members shall not trade", None, None, 0.0, "high"),
        ("Members shall not trade but may consider it", None, None, 0.0, "high"),
        ("Members may consider it", None, None, 0.0, "low"),
        ("Members may consider it", "relative", None, 0.0, "medium"),
        ("Members file it", "fixed", None, 0.0, "medium"),
        ("Members file it", None, "high", 0.60, "high"),
        ("Members file it", None, "high", 0.59, "medium"),
        ("Members file it", None, None, 0.0, "medium"),
        ("Assets are segregated", None, None, 0.0, "medium"),
    ],
)
def test_severity(spark, text, kind, model, confidence, severity):
    assert one(spark, X.severity(F.lit(text), F.lit(kind).cast("string"), F.lit(model).cast("string"), F.lit(confidence)))["severity"] == severity


def test_fields(spark):
    s = F.lit("Every stock broker shall report to the Board within 30 days and maintain a register of complaints.")
    assert one(spark, X.responsible(s)) == "Board of Directors"
    assert one(spark, X.responsible(F.lit("stock brokers shall act"))) == "Stock Brokers — Compliance Officer"
    assert one(spark, X.responsible(F.lit("the audit committee acts"))) == "Audit Committee"
    assert one(spark, X.action(s)) == "Report to the Board within 30 days and maintain a register of complaints"
    assert one(spark, X.action(F.lit("nothing binding"))) == "nothing binding"
    assert one(spark, X.named_types(F.lit("listed entities and stock brokers"))) == ["listed_company", "stockbroker"]
    assert one(spark, X.evidence(s)) == ["Minutes of the meeting", "Agenda note placed before the body", "Copy of the submitted report", "Acknowledgement from the recipient"]
    assert one(spark, X.evidence(F.lit("nothing"))) == list(L.DEFAULT_EVIDENCE)
    assert one(spark, X.keywords(s)) == ["stock", "broker", "report", "board", "days", "maintain"]
    assert one(spark, X.mandatory_terms(s)) == ["shall", "maintain"]
    assert one(spark, X.title(F.lit(" ".join("abcdefghijklm")), s)) == "A b c d e f g h i j k…"
    assert one(spark, X.priority(F.lit("low"), F.lit("recurring"), F.lit(7))) == "high" and one(spark, X.priority(F.lit("low"), F.lit("recurring"), F.lit(-1))) == "critical"
    assert one(spark, X.applies_to(F.array(F.lit("rta")), F.array().cast("array<string>"), F.array(F.lit("stockbroker")))) == ["stockbroker"]
    assert one(spark, X.token_overlap(F.lit("alpha beta gamma"), F.lit("beta gamma delta epsilon"))) == pytest.approx(2 / 3)


def test_alerts(spark):
    rows = [(1, "high", "red", -3), (2, "medium", "yellow", 0), (3, "medium", "yellow", 7), (4, "high", "red", 8), (5, "high", "green", -1), (6, "low", "red", -1)]
    q = spark.createDataFrame(rows, "obligation_id int, severity string, evidence_status string, days_remaining int").withColumn("overdue", F.col("days_remaining") < 0)
    assert {r.obligation_id: r.rule for r in K.alerts(q).collect()} == {1: "OVERDUE", 2: "DUE_SOON", 3: "DUE_SOON"}
    now = dt.datetime(2026, 3, 1)
    reg = spark.createDataFrame([(1, "high", "green", now - dt.timedelta(hours=23)), (2, "high", "red", now - dt.timedelta(hours=25)), (3, "medium", "red", now)], "obligation_id int, severity string, evidence_status string, created_at timestamp")
    assert [r.obligation_id for r in K.new_high(reg, F.lit("2026-03-01 00:00:00").cast("timestamp")).collect()] == [1]


def test_responses(spark):
    row = "struct<title:string,description:string,required_action:string,evidence_requirements:array<string>>"
    a, b = '{"title": "a", "description": "must {x}"}', '{"title": "b"}'
    raw = [(1, f"[{a}, {b}]"), (2, f"```json\n[{a}]\n```"), (3, '{"obligations": [' + a + "]}"), (4, f"[{a}, {b}, {{\"title\": \"cut"), (5, "sorry, nothing"), (6, None)]
    got = CH.decode_responses(spark.createDataFrame(raw, "chunk_id int, raw string"), row)
    counts = {r.chunk_id: r.n for r in got.filter("row is not null").groupBy("chunk_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 2, 2: 1, 3: 1, 4: 2}
    assert {r.chunk_id for r in got.filter("row is null").collect()} == {5, 6}
    done = CH.response_obligations(got).filter("title = 'a'").first()
    assert done.confidence == 0.95 and done.triggers == ["must"]


def test_upsert(spark):
    reg = spark.createDataFrame([(1, "a"), (2, "b")], "obligation_id int, v string")
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "obligation_id int, v string")
    once = R.upsert(reg, batch)
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, R.upsert(once, batch).collect()))


def test_upsert_of_equal_order_does_not_depend_on_the_order_of_rows(spark):
    reg = spark.createDataFrame([(1, "a", None)], "obligation_id int, status string, at int")
    rows = [(1, "N", 7), (1, "R", 7), (1, "A", 7), (1, "Z", 6)]
    for batch in (rows, rows[::-1], rows[1:] + rows[:1]):
        out = R.upsert(reg, spark.createDataFrame(batch, "obligation_id int, status string, at int").coalesce(1), order="at")
        assert [tuple(r) for r in out.collect()] == [(1, "R", 7)]


def test_similarity_by_prefixes_loses_nothing(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights=[40 - k for k in range(40)], k=rng.randint(3, 12)))) for i in range(60)]
    v = S.tfidf(spark.createDataFrame(rows, "id int, text string"), stops=())
    want = {(r.a, r.b) for r in S.cosines(v, v).filter("similarity >= 0.4 and a <> b").collect()}
    assert want and want == {(r.a, r.b) for r in S.matches(v, v, 0.4).filter("a <> b").collect()}


def test_retrieval_has_no_cartesian_product(spark):
    p = spark.createDataFrame([("p1", "s", "margin report daily"), ("p2", "s", "training for staff")], "passage_id string, section string, text string")
    q = spark.createDataFrame([("q", "daily margin"), ("none", "zebra")], "question_id string, question string")
    found = S.retrieve(p, q)
    assert [(r.question_id, r.passage_id) for r in found.collect()] == [("q", "p1")]
    texts = {r.question_id: r.answer for r in S.answers(found, p, q).collect()}
    assert "margin report daily" in texts["q"] and texts["none"].startswith("Nothing")
    plan = S.matches(S.tfidf(p, key="passage_id"), S.tfidf(p, key="passage_id"), 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin LeftOuter" not in plan
