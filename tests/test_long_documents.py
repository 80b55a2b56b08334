"""Folds over a document's blocks and lines: places and sizes in a document of ten megabytes, and of hard rows."""

import time

from pyspark.sql import functions as F

from statuta.operators import text as T

SCHEMA = "circular_id string, document_text string"


def test_a_document_of_ten_megabytes(spark):
    line = "The member shall keep a register of all orders and file it with the exchange in time."
    n = 115_000
    text = "\n".join(f"{i % 9 + 1}.{i % 7 + 1} {line}" if i % 50 else f"{i // 50 + 1}. GENERAL DUTIES" for i in range(n))
    assert len(text) > 9_500_000
    df = spark.createDataFrame([("long", text), ("short", "1.1 One line that is long enough to be a passage of its own.")], SCHEMA)
    began = time.time()
    sizes = {r.circular_id: r for r in T.chunks(df).groupBy("circular_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.max(F.length("text")).alias("most")).collect()}
    packed = {r.circular_id: r for r in T.passages(df).groupBy("circular_id").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max(F.length("text")).alias("most")).collect()}
    assert time.time() - began < 120
    assert sizes["short"].n == packed["short"].n == 1
    assert sizes["long"].n >= n // 50 - 1 and sizes["long"].c > 0.98 * len(text) and sizes["long"].most < 6200
    assert packed["long"].n > 8_000 and packed["long"].most <= 1000 and packed["long"].last >= packed["long"].n - 1


def test_hard_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n\t\n"), (None, "PART ONE\nsome words that follow the heading of this part\n"), ("d", "x" * 7000)], SCHEMA)
    assert sorted((str(r.circular_id), r.chunk_no, len(r.text), r.section_hint) for r in T.chunks(df).collect()) == [("None", 0, len("PART ONE some words that follow the heading of this part"), "General"), ("d", 0, 7000, "General")]
    got = {(str(r.circular_id), r.passage_id): len(r.text) for r in T.passages(df).collect()}
    assert got[("d", "p000")] == 7000 and {k for k, _ in got} == {"None", "d"}
    assert T.chunks(df.limit(0)).count() == T.passages(df.limit(0)).count() == 0


def test_no_row_of_the_timeline_gathers_a_hot_deadline(spark):
    from statuta.operators import graph as G

    n = 20_000
    register = spark.range(n).select(F.col("id").alias("obligation_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("within 30 days").alias("deadline"))
    spread = spark.range(n).select(F.col("id").alias("node"))
    rows = G.timeline_blocks(spread, register, 500).select("deadline", "blocks", "obligation_count", F.size("ids").alias("n"), "ids").collect()
    assert max(r.n for r in rows) < 700 and all(r.n == r.obligation_count and r.ids == sorted(r.ids) for r in rows)
    hot = [r for r in rows if r.deadline == "within 30 days"]
    assert len(hot) == hot[0].blocks == 27 and sorted(i for r in rows for i in r.ids) == list(range(n))
