"""Cheaper forms of text and similarity steps give what their full forms give."""

from pyspark.sql import functions as F

from statuta.operators import similarity as S
from statuta.operators import text as T


def test_line_sentences_equal_block_sentences_on_clean_lines(spark):
    lines = ["", "12", "page 3 of 4", "Page 3 of 4 is blank.", "3 of 4", "One. Two of no. 5 costs 3.50! Three", "a; b; cde", "It is 12"]
    rows = spark.createDataFrame([(x,) for x in lines], "t string")
    got = rows.select("t", T.line_sentences(F.col("t")).alias("a"), T.block_sentences(F.col("t")).alias("b")).collect()
    assert len(got) == len(lines)
    assert all(r.a == r.b for r in got), [r for r in got if r.a != r.b]
    assert {r.t: r.a for r in got}["page 3 of 4"] == []


def test_units_carry_columns(spark):
    docs = spark.createDataFrame([("c", "T", "The member shall file. It is due.")], "circular_id string, title string, document_text string")
    assert [(r.order, r.title) for r in T.units(docs, carry=["title"]).collect()] == [(1, "T"), (2, "T")]


def test_small_left_finds_the_same_pairs(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [(i, " ".join(words[(i * k) % 8] for k in range(1, 6))) for i in range(40)]
    rows = S.tfidf(spark.createDataFrame(texts, "id int, text string"), stops=["none"])
    left, right = rows.filter("id < 5"), rows.filter("id >= 5")
    pairs = lambda small: {(r.a, r.b, round(r.similarity, 9)) for r in S.matches(left, right, 0.6, small_left=small).collect()}
    brute = {(r.a, r.b, round(r.similarity, 9)) for r in S.cosines(left, right).filter("similarity >= 0.6").collect()}
    assert brute and pairs(True) == pairs(False) == brute
