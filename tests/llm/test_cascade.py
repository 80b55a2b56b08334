"""The cascade's order is stable, its sample is bounded, and rules are tried only on what earlier ones left."""

from pyspark.sql import functions as F

from statuta.llm import quality_rules as q

DIR = "/root/testdata/sf0.01"


def test_the_order_is_the_same_in_each_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    orders = [[r["rule"] for r in q.order_by_rejection_per_cost(docs, q.text_rules(), costs=q.text_costs())] for _ in range(10)]
    assert all(o == orders[0] for o in orders) and sorted(orders[0]) == sorted(q.text_rules())


def test_dear_rules_come_after_cheap_ones(spark):
    df = spark.range(300).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    dear = lambda t: F.size(F.filter(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(t, i.cast("string")).rlike("^t1[0-9]*zz"))) == 0
    found = q.order_by_rejection_per_cost(df, {"dear": dear, "cheap": lambda t: t.rlike("[0-4]$")})
    assert [r["rule"] for r in found] == ["cheap", "dear"] and found[1]["selectivity"] == 1.0


def test_later_rules_are_tried_on_what_is_left(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rules, order = q.text_rules(), ["too_few_words", "symbols", "repeated_lines", "repeated_words", "word_length"]
    counts = q.evaluated_counts(docs, rules, order)
    left = docs.count()
    for name, tried, rejected in counts:
        assert tried == left and rejected == docs.filter(q.cascade(F.col("text"), rules, order) == name).count()
        left -= rejected
    assert left == q.filter_by_rules(docs).count() and counts[-1][1] < counts[0][1]


def test_the_sample_does_not_read_all_partitions(spark):
    """A row that fails the job stands in the last partition: the estimate never meets it."""
    df = spark.range(0, 4000, 1, 40).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("read")).cast("string")).otherwise(F.col("id").cast("string")).alias("text"))
    assert q.order_by_rejection_per_cost(df, {"a": lambda t: t == "1"})[0]["rule"] == "a"


def test_rules_on_hard_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 60), (4, "a b " * 60), (None, " ".join(f"word{i}" for i in range(60)))], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("rule", "n", "time", "n_words", "kept")})
    got = q.judge(df.select("doc_id", "text", "rule", "n", "time"))
    assert sorted((str(r.doc_id), r.n_words, r.n_repeat_words, r.kept) for r in got.collect()) == [("1", 0, 0, False), ("2", 0, 0, False), ("3", 0, 0, False), ("4", 120, 120, False), ("4", 120, 120, False), ("None", 60, 0, True)]
    assert [r.doc_id for r in q.filter_by_rules(df).collect()] == [None] and q.filter_by_rules(df).columns == df.columns
    assert q.judge(df.limit(0)).count() == 0


def test_rows_that_fail_the_base_verdict_are_tried_on_no_rule(spark):
    """A rule that fails the job wherever it is evaluated on such a row; the first rule in the order keeps the second from its rows."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.col("doc_id").cast("string")))
    c = F.col
    boom = lambda when: F.when(when, F.raise_error(F.lit("reached")).cast("boolean"))
    rules = {
        "first": lambda t: boom(c("base_failed")).otherwise(t.rlike("[0-4]$")),
        "second": lambda t: boom(c("base_failed") | (c("doc_id").isNotNull() & t.rlike("[0-4]$"))).otherwise(F.size(F.split(t, "\\s*\\s*x")) < 0),
    }
    out = q.judge(docs, rules=rules)
    kept = out.filter("kept").select("doc_id").collect()
    assert kept and all(r.doc_id % 10 > 4 for r in kept) and out.count() == docs.count()
    rest = q.measured(docs).filter("not base_failed")
    assert len(kept) == rest.filter("doc_id % 10 > 4").count() < rest.count() < docs.count()


def test_the_order_is_made_of_the_rules_that_are_tried(spark):
    """On rows that pass the base verdict: cost and selectivity of the later rules as they stand in the query."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    passed = q.measured(docs.select("doc_id", "text")).filter("not base_failed").cache()
    found = q.order_on(passed, q.later_rules())
    assert sorted(r["rule"] for r in found) == sorted(q.later_rules())
    n = passed.count()
    for r in found:
        assert r["selectivity"] == passed.filter(q.later_rules()[r["rule"]](F.col("text"))).count() / n
    assert [r["rank"] for r in found] == sorted((r["rank"] for r in found), reverse=True)
