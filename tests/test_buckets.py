"""Tables in hash buckets: what an upsert rewrites, crashes between its steps, streams over them."""

import pytest
from pyspark.sql import functions as F

from statuta.sources import buckets as B
from statuta.sources import writers as W
from statuta.streaming import ingest as N

SCHEMA = "obligation_id long, v string"


def rows_of(spark, path, schema=SCHEMA):
    return sorted(tuple(r) for r in B.read_buckets(spark, path, schema).collect())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], SCHEMA)
    assert rows_of(spark, path) == []
    assert B.upsert_buckets(spark, path, make(range(500), "old"), SCHEMA, buckets=16) == list(range(16))
    before = B._manifest(spark, path)
    touched = B.upsert_buckets(spark, path, make([3, 77, 1000], "new"), SCHEMA, buckets=99)  # the number is fixed once
    after = B._manifest(spark, path)
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b][0] != before[b][0]} == set(touched)
    assert sum(v[1] for v in after.values()) == 501
    want = sorted([(i, "new" if i in (3, 77) else "old") for i in range(500)] + [(1000, "new")])
    assert rows_of(spark, path) == want
    # an upsert that runs again leaves the same; an empty batch rewrites nothing
    assert B.upsert_buckets(spark, path, make([3, 77, 1000], "new"), SCHEMA) == touched and rows_of(spark, path) == want
    assert B.upsert_buckets(spark, path, make([], ""), SCHEMA) == []
    plan = B.read_buckets(spark, path, SCHEMA, touched)
    assert {r.b for r in plan.select(B.bucket_of("obligation_id", 16).alias("b")).collect()} == set(touched)
    assert B.vacuum(spark, path) == 2 * len(touched) and rows_of(spark, path) == want and B.vacuum(spark, path) == 0


def test_a_crash_before_the_swap_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), spark.createDataFrame([(2, "c"), (3, "d")], SCHEMA)
    B.upsert_buckets(spark, path, old, SCHEMA, buckets=4)

    def broken(df, at):
        raise OSError("lost")

    monkeypatch.setattr(B, "replace_table", broken)
    with pytest.raises(OSError):
        B.upsert_buckets(spark, path, new, SCHEMA)
    assert rows_of(spark, path) == [(1, "a"), (2, "b")]
    monkeypatch.setattr(B, "replace_table", W.replace_table)
    B.upsert_buckets(spark, path, new, SCHEMA)
    assert rows_of(spark, path) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError):
        B.change_buckets(spark, path, new, SCHEMA, "obligation_id", lambda o, n: n.withColumn("obligation_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long")))).select("obligation_id", "v"))


def test_ingestion_into_buckets_equals_the_plain_table(spark, tmp_path):
    docs = [(f"u{i % 30}", f"c{i % 30}", "t", "k", "d", ("x" * (150 if i % 4 else 20)) + str(i % 30)) for i in range(40)]
    for part in range(4):
        spark.createDataFrame(docs[part * 10 : part * 10 + 10], N.DOCUMENTS).coalesce(1).write.mode("append").json(f"{tmp_path}/src")
    keep = lambda new: new.select(F.col("circular_id").alias("obligation_id"), F.length("document_text").alias("n"))
    schema = "obligation_id string, n int"
    for name, buckets in (("plain", None), ("dealt", 8)):
        for again in range(2):  # the second stream meets documents that are all seen
            N.ingest(spark, f"{tmp_path}/src", f"{tmp_path}/{name}", f"{tmp_path}/{name}-seen", f"{tmp_path}/{name}-cp{again}", keep, schema, most_files=1, buckets=buckets).awaitTermination()
    plain = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/plain").collect())
    assert plain and plain == rows_of(spark, f"{tmp_path}/dealt", schema)
    seen = lambda df: sorted(r.detail_url for r in df.collect())
    assert seen(spark.read.parquet(f"{tmp_path}/plain-seen")) == seen(B.read_buckets(spark, f"{tmp_path}/dealt-seen", W.SEEN))


def test_checklists_in_buckets(spark, tmp_path):
    path, schema = f"{tmp_path}/reg", "obligation_id string, evidence_status string"
    B.upsert_buckets(spark, path, spark.createDataFrame([(f"o{i}", "red") for i in range(50)], schema), schema, buckets=8)
    before = B._manifest(spark, path)
    batch = N.checklist_batch(path, f"{tmp_path}/upd", schema, buckets=8)
    updates = spark.createDataFrame([("o1", "i1", True, 1), ("o1", "i2", False, 1), ("unknown", "i", True, 1)], "obligation_id string, item_id string, completed boolean, ts int")
    batch(updates, 0), batch(updates, 0)
    after = B._manifest(spark, path)
    assert dict(rows_of(spark, path, schema)) == {f"o{i}": "yellow" if i == 1 else "red" for i in range(50)}
    assert 1 <= len({b for b in after if after[b] != before[b]}) <= 2
