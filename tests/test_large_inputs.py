"""Properties that keep the operators' work in proportion to their input."""

import random

from pyspark.sql import functions as F

from statuta.operators import changes as CH
from statuta.operators import evaluate as EV
from statuta.operators import graph as G
from statuta.operators import insights as I
from statuta.operators import risk as K
from statuta.operators import similarity as S
from statuta.plans import model_queries as M
from statuta.sources import buckets as B


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_reads_a_text_once(spark):
    rows = spark.createDataFrame([(0, i, " ".join(f"word{chr(97 + (i + j) % 26) * 3}" for j in range(9))) for i in range(30)], "doc int, id int, text string")
    found = EV.overlap_matches(rows, rows.filter("id < 20"))
    # its words are made before they are dealt out, not again beside each of them
    assert [x for x in plan(found).splitlines() if "Project" in x and "regexp_extract_all" in x] == []
    assert found.filter("overlap = 1").count() == 24  # those below 20, and 26 to 29, which repeat 0 to 3


def shuffled(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator()
    total = 0
    while executors.hasNext():
        total += executors.next().totalShuffleWrite()
    return total


def test_diff_moves_what_the_asked_texts_can_match(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(400)]
    texts[7] = texts[107] + " more"
    texts[8] = texts[9] = texts[108]  # equal texts on both sides
    texts[209] = texts[108]
    kinds = [("deadline", "string"), ("deadline_type", "string"), ("severity", "string"), ("responsible_party", "string"), ("intermediary_types", "array<string>"), ("evidence_requirements", "array<string>")]
    schema = "obligation_id int, title string, description string, " + ", ".join(f"{n} {t}" for n, t in kinds)
    rows = spark.createDataFrame([(i, "", t, None, None, "low", None, [], []) for i, t in enumerate(texts)], schema)
    asked = F.col("obligation_id").between(6, 9)
    before = shuffled(spark)
    got = {r["new_id"]: (r["old_id"], r["change_class"]) for r in CH.lexical_diff(rows.filter(asked), rows.filter(~asked)).collect()}
    assert got == {"6": (None, "NEW"), "7": ("107", "UNCHANGED"), "8": ("108", "UNCHANGED"), "9": ("108", "UNCHANGED")}
    # all terms of all texts, moved once, would be some megabytes
    assert shuffled(spark) - before < 1_000_000


def test_reach_moves_a_level_only_where_it_must(spark):
    """Many roots that lead to few nodes: the way from these on is joined to the roots without moving all edges again."""
    first = spark.range(40_000).select(F.concat(F.lit("p"), "id").alias("src"), F.concat(F.lit("s"), F.col("id") % 50).alias("dst"))
    rest = spark.range(50).select(F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("n"), F.col("id") % 5).alias("dst"))
    edges = first.unionByName(rest).localCheckpoint()
    before = shuffled(spark)
    found = G.reachable(edges, edges.select(F.col("src").alias("root")).distinct())
    moved = shuffled(spark) - before
    assert [tuple(r) for r in found.groupBy("depth").count().orderBy("depth").collect()] == [(1, 40_050), (2, 40_000)]
    assert moved < 1_100_000


def test_keyword_profile_moves_texts_and_not_their_terms(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 4 + rng.choice("abcdefgh") * 3 for _ in range(400)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "circular_id int, document_text string")
    found = I.keyword_profile(docs).collect()
    assert len({r["circular_id"] for r in found}) == 200
    plan = I.keyword_profile(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_nearest_vectors_in_parts_equal_all_pairs(spark):
    """Parts of few rows against all pairs in Spark, with copies, nulls, odd lengths and values that are no numbers; nothing is broadcast, and the plan does not grow."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)] + [(1100, None), (1101, []), (1102, [1.0]), (1103, [0.1, None, 0.2, 0.3, 0.1, 0.2]), (1104, [float("nan")] + [0.0] * 5), (1105, [float("inf")] + [0.0] * 5), (1120, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").localCheckpoint()
    asked = table.filter("vec_id % 3 = 0 or vec_id > 1099")
    distance = F.aggregate(F.zip_with(F.col("q").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = table.crossJoin(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))).select("query_id", "vec_id", (1 / (1 + distance)).alias("similarity")).filter("similarity >= 0.6 and query_id <> vec_id")
    want = pairs.withColumn("rank", F.expr("row_number() over (partition by query_id order by round(similarity, 9) desc, vec_id)")).filter("rank <= 4")
    show = lambda df: sorted(map(str, df.select("query_id", "vec_id", "similarity", "rank").collect()))
    for part_rows in (37, 20_000):
        found = S.nearest_vectors(table, asked, k=4, at_least=0.6, part_rows=part_rows)
        assert show(found) == show(want)
    assert "Broadcast" not in S.nearest_vectors(table, asked, part_rows=20)._jdf.queryExecution().executedPlan().toString()


def test_retrieval_moves_terms_as_hashes_and_adds_up_where_passages_are(spark):
    rng = random.Random(9)
    texts = [" ".join(["often"] + [f"{rng.getrandbits(128):032x}z" for _ in range(300)]) for _ in range(200)]
    passages = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string").localCheckpoint()
    questions = spark.createDataFrame([(i, "often " + texts[i][6:200]) for i in range(40)], "question_id int, question string")
    before = shuffled(spark)
    got = S.retrieve(passages, questions, k=2, stops=[]).collect()
    assert len(got) == 80 and all(r["passage_id"] == r["question_id"] for r in got if r["rank"] == 1)
    # as text and for every join, they were 11 MB
    assert shuffled(spark) - before < 7_000_000


def test_profile_cleans_a_text_once(spark):
    # a second cleaning would take the joined line for a page number
    docs = spark.createDataFrame([(1, "A line here.\npag-\ne 12\nMore text here.")], "circular_id int, document_text string")
    assert I.profile(docs).first()["longest_sentence_words"] == 5
    assert plan(I.profile(docs).select("sentences")).count(r"(?:page\s+)?\d+(?:\s+of\s+\d+)?") == 1


def test_large_buckets_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 100, raising=False)
    rows, schema = spark.range(2000).select(F.col("id").alias("obligation_id"), F.lit("a").alias("x")), "obligation_id long, x string"
    B.upsert_buckets(spark, str(tmp_path / "t"), rows, schema, buckets=2)
    B.upsert_buckets(spark, str(tmp_path / "t"), rows.filter("obligation_id < 50").withColumn("x", F.lit("b")), schema, buckets=2)
    held = B.read_buckets(spark, str(tmp_path / "t"), schema)
    assert len(held.inputFiles()) >= 8 and {r.x: r["count"] for r in held.groupBy("x").count().collect()} == {"a": 1950, "b": 50}


def test_a_stream_takes_any_number_of_files_in_two_batches(spark, tmp_path):
    for n in (1, 2, 7):
        spark.range(100).repartition(n).write.json(str(tmp_path / f"s{n}"))
    assert [M._half(spark, str(tmp_path / f"s{n}"), "text") for n in (1, 2, 7)] == [1, 1, 4]


def test_procedures_are_written_after_their_join(spark):
    kinds = "obligation_id int, clause_reference string, required_action string, evidence_requirements array<string>, responsible_party string, deadline string"
    register = spark.createDataFrame([(1, "Clause 4", "File it", ["a", "b", "c", "d"], "Desk", "1998-08-02"), (2, None, None, None, None, None)], kinds)
    found = K.with_steps(spark.createDataFrame([(1,), (2,), (3,)], "obligation_id int"), register)
    # the steps, most of them fixed text, would be sorted with every row
    above, below = plan(found).split("Join LeftOuter")
    assert "Step 6" in above and "Step 6" not in below
    assert found.columns == ["obligation_id", "procedure"]
    got = {r.obligation_id: r.procedure for r in found.collect()}
    assert got[3] is None and len(got[1]) == len(got[2]) == 6  # no obligation, and one without any field
    assert "evidence — a, b, c. Store" in got[1][3] and got[1][4].endswith("to Desk for sign-off before 1998-08-02.")
    assert got[2][4].endswith("to Compliance Officer for sign-off before the applicable regulatory deadline.")
