"""Tables that are swapped stay whole whatever step a crash comes after; batches that run again change nothing."""

import pytest
from pyspark.sql import functions as F

from statuta.sources import writers as W
from statuta.streaming import ingest as N


@pytest.mark.parametrize("step", range(5))
def test_a_broken_swap_is_brought_to_its_end(spark, tmp_path, step):
    path = f"{tmp_path}/t"
    old, new = spark.range(3), spark.range(10, 15)
    W.replace_table(old, path)
    fs, target = W._fs(spark, path)
    (_, staging), (_, aside) = W._fs(spark, f"{path}.staging"), W._fs(spark, f"{path}.old")
    if step == 1:  # while the new files are written
        new.write.parquet(f"{path}.staging")
        fs.delete(W._fs(spark, f"{path}.staging/_SUCCESS")[1], False)
    if step >= 2:
        new.write.parquet(f"{path}.staging")
    if step >= 3:
        fs.rename(target, aside)
    if step == 4:
        fs.rename(staging, target)
    want = {0, 1, 2} if step < 3 else {10, 11, 12, 13, 14}
    assert {r.id for r in W.read_or_empty(spark, path, "id long").collect()} == want
    W.replace_table(spark.range(7, 9), path)
    assert {r.id for r in W.read_or_empty(spark, path, "id long").collect()} == {7, 8}
    assert not W.exists(spark, f"{path}.old") and not W.exists(spark, f"{path}.staging")


def test_old_files_come_back_where_the_new_are_not_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(f"{path}.old")
    spark.range(5).write.parquet(f"{path}.staging")
    fs, mark = W._fs(spark, f"{path}.staging/_SUCCESS")
    fs.delete(mark, False)
    assert W.read_or_empty(spark, path, "id long").count() == 3


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    batch = spark.createDataFrame([("o1", "i1", True, "2026-01-01 00:00:00"), ("o1", "i2", False, "2026-01-01 00:00:00")], "obligation_id string, item_id string, completed boolean, at string").withColumn("at", F.col("at").cast("timestamp"))
    for _ in range(2):
        W.write_batch(batch, f"{tmp_path}/log", 3)
    W.write_batch(batch, f"{tmp_path}/log", 4)
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_run_metrics(spark):
    r = W.run_metrics(spark.createDataFrame([("r", "c", 7000, 5, 1.25), ("s", "c", 0, 0, 0.0)], "run_id string, circular_id string, chars int, obligations int, seconds double")).orderBy("run_id").collect()
    assert [(x.pages, x.obligations_per_page) for x in r] == [(2, 2.5), (1, 0.0)] and r[0].summary == "5 obligations from 7000 characters in 1.3 s"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from statuta import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(ValueError):
        session.scratch_path(Session(), "x")
