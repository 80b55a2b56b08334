"""Texts take time in proportion to their length, and patterns that are tried on few texts find what they found on all."""

import time

import pytest
from pyspark.sql import functions as F

from statuta.functions import fields as X
from statuta.functions import lexicon as L
from statuta.functions.columns import folded, squeeze, strip
from statuta.operators import classify as K
from statuta.operators import text as T

TEXTS = (
    "It ſhall be kept wİthin ten days", "WITHIN 30 working days", "on a Half-Yearly basis", "at the end of every calendar quarter", "on a continuous basis", "The Board and the audıt committee", "the Head of Operations", "Designated Authority",
    "RTAs act", "depositories act", "a registrar to an issue and share transfer agent acts", "listed entity", "asset management companies", "intermediary", "members are required to file all reports", "they may not do that at all", "no member shall",
    "under no circumstance", "clients' funds", "misutilisation", "proprietary trade", "report to sebi", "str", "intimate the Board", "shall be deemed to have violated", "liable", "same day", "not later than the next day", "forthwith", "unpublished price sensitive",
    "unauthorised access", "encrypt", "may choose", "endeavour", "best effort", "as far as possible", "disseminate", "display on its website", "format is prescribed", "for the sake of", "guidance of", "is obliged to", "is to be", "has to", "need to", "are prohibited",
    "at its discretion", "the risK desk", "plain words", "",
)


@pytest.mark.parametrize("name", sorted(L.STEMS))
def test_stems_lose_no_match(spark, name):
    pattern = X.I + ({"relative": L.RELATIVE, "frequency": L.FREQUENCY, "roles": L.ROLES, "entities": L.ENTITIES, "action": L.ACTION} | L.HIGH_SEVERITY | L.LOW_SEVERITY | L.FEATURES)[name]
    s = F.col("s")
    rows = spark.createDataFrame([(x,) for x in TEXTS], "s string").select("s", X.found(s, name, pattern).alias("a"), X.found(s, name, pattern, folded(s)).alias("b"), s.rlike(pattern).alias("c"), X.extract(s, name, "(" + pattern + ")").alias("d"), F.regexp_extract(s, "(" + pattern + ")", 1).alias("e"))
    rows = rows.collect()
    assert any(r.c for r in rows)
    assert [(r.s, r.a, r.b, r.d) for r in rows] == [(r.s, r.c, r.c, r.e) for r in rows]


def test_white_space(spark):
    texts = ["a b", " a  b ", "a \tb", "a\t b\n", " a  b　", "a b \n", " ", "\n", "", "a b", "a b  c d", "\x1ca\x1c"]
    s = F.col("s")
    old = F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    for r in spark.createDataFrame([(x,) for x in texts], "s string").select("s", strip(s).alias("a"), old[0].alias("b"), squeeze(s).alias("c"), old[1].alias("d")).collect():
        assert (r.s, r.a, r.c) == (r.s, r.b, r.d)


def test_clean_text_is_as_before(spark):
    texts = ["a-\nb-\nc", "a-\n b", "é-\nx", "a \t b\t\tc \t", "--\na", "x\n\n\n\ny", "1-\n2a"]
    for r in spark.createDataFrame([(x,) for x in texts], "s string").select("s", T.clean_text(F.col("s")).alias("a"), strip(F.regexp_replace(F.regexp_replace(F.regexp_replace("s", r"(?U)(\w)-\n(\w)", "$1$2"), r"[ \t]+", " "), r"\n{3,}", "\n\n")).alias("b")).collect():
        assert (r.s, r.a) == (r.s, r.b)


def test_one_long_line_takes_time_by_its_length(spark):
    n = 12_000
    text = "1.2 " + " ".join(f"Member number {i} shall keep a register of its orders and file it with the exchange in time." for i in range(n))
    df = spark.createDataFrame([("d", "t", text)], "circular_id string, title string, document_text string")
    T.units(df.limit(0)).count()
    began = time.time()
    out = K.extract_obligations(df).agg(F.count("*").alias("n"), F.max("order").alias("last"), F.countDistinct("clause_reference").alias("c")).collect()[0]
    assert (out.n, out.last) == (n, n) and out.c == n
    assert time.time() - began < 40


def test_texts_are_dealt_before_they_are_cut(spark):
    docs = spark.createDataFrame([(str(i), "t", f"The member {i} shall file a report within {i} days.") for i in range(40)], "circular_id string, title string, document_text string").coalesce(1)
    plan = K.extract_obligations(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
