"""Extra columns of any name, nulls, repeated rows and empty tables in the operators that return whole rows."""

import pytest
from pyspark.sql import functions as F

from statuta.llm.secret_scan import redact, scan
from statuta.llm.sharding import assign, write_shards

KEY = "AKIA" + "Q" * 16
TEXTS = [None, "", "nothing", f"id {KEY} password=abc1234 end", "password=abcdefghijklmnop tail", f"é {KEY} \U0001f600 {KEY}", "password=abc1234 alone", "password=abcdefghijklmnop tail"]
NAMES = ["_digest", "_cuts", "_id", "_of", "tag", "row", "cuts", "linked", "changed", "key", "h", "k", "_h", "_k", "piece", "size", "assign", "a.b"]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(None if i == 2 else i, t, None if t is None else len(t)) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], len(TEXTS[4]))]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumns({n: F.lit(n) for n in NAMES})


def test_redact(wide):
    out = redact(wide)
    assert out.columns == wide.columns and out.schema.simpleString() == wide.schema.simpleString()
    got = out.collect()
    assert len(got) == len(TEXTS) + 1 and all(r[n] == n for r in got for n in NAMES)
    by = {r.doc_id: r.text for r in got}
    assert by[0] is None and by[1] == "" and by[None] == "nothing" and by[6] == TEXTS[6]
    assert by[3] == "id [SECRET] [SECRET] end" and by[4] == by[7] == "[SECRET] tail" and by[5] == "é [SECRET] \U0001f600 [SECRET]"
    assert sum(r.doc_id == 4 for r in got) == 2
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert redact(wide.limit(0)).count() == 0 and scan(wide.limit(0)).count() == 0 and scan(wide).count() == len(got)


def test_texts_of_rows_without_weak_parts_are_not_moved(wide):
    plan = redact(wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "needs" not in plan and plan.count("Join") == 2  # the interval join and that of its few rows


@pytest.mark.parametrize("pieces", [1, 3, None])
def test_written_shards(spark, wide, tmp_path, pieces):
    many = wide.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("doc_id", F.col("doc_id") * 100 + F.col("n")).withColumn("text", F.concat("text", F.lit(" "), F.col("n").cast("string")))
    write_shards(many, f"{tmp_path}/out", shards=5, pieces=pieces)
    back = spark.read.parquet(f"{tmp_path}/out")
    key = ["doc_id", "text", *[f"`{n}`" for n in NAMES]]
    assert back.count() == many.count() and back.select(*key).exceptAll(many.select(*key)).count() == 0
    mine = sorted(r["count"] for r in back.groupBy("shard").count().collect())
    want = sorted(r["count"] for r in assign(many, shards=5, pieces=pieces).groupBy("shard").count().collect())
    assert mine == want
    files = back.select("shard", F.input_file_name().alias("f")).distinct().groupBy("shard").count()
    assert files.agg(F.max("count")).first()[0] <= (pieces or 1)


def test_shards_of_odd_tables(spark, wide, tmp_path):
    write_shards(wide.limit(0), f"{tmp_path}/none", shards=5)
    with pytest.raises(ValueError):
        write_shards(wide.withColumn("shard", F.lit(1)), f"{tmp_path}/clash")
    assert assign(wide).count() == wide.count() and assign(wide.limit(0)).count() == 0
