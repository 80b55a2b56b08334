"""Keyed tables in hash buckets behind a manifest: an upsert reads and writes the buckets of its keys and no others.

Below the table's folder lie ``data/<version>/bucket=<n>`` and ``manifest``, a table of (bucket, folder, rows). New folders are written
whole before the manifest is swapped, so whatever step a crash comes after, the manifest names whole folders only, and an
upsert that runs again leaves the same rows. A bucket is the hash of the key; their number is fixed when the table is made.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from statuta.sources.writers import _fs, read_or_empty, replace_table

MANIFEST = "bucket int, folder string, rows long, buckets int"
#: Buckets of a new table where nothing else is said.
BUCKETS = 64
#: About so many rows of a bucket are written by one task.
PART_ROWS = 250_000


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> dict[int, tuple[str, int, int]]:
    """At most as many rows as buckets."""
    return {r["bucket"]: (r["folder"], r["rows"], r["buckets"]) for r in read_or_empty(spark, f"{path}/manifest", MANIFEST).collect()}


def read_buckets(spark: SparkSession, path: str, schema: t.StructType | str, only: Iterable[int] | None = None) -> DataFrame:
    """The table's rows, or those of ``only`` these buckets; an empty table where there is none yet."""
    held = _manifest(spark, path)
    folders = sorted(f"{path}/data/{held[b][0]}" for b in (held if only is None else set(only) & set(held)))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def touched_buckets(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """The buckets that the rows' keys fall in, and how many the table has (``buckets`` where it is new)."""
    sizes, n = _touched(spark, path, rows, key, buckets)
    return sorted(sizes), n


def _touched(spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int) -> tuple[dict[int, int], int]:
    """Buckets that the rows fall in with the number of these rows, and how many buckets the table has."""
    held = _manifest(spark, path)
    n = next(iter(held.values()))[2] if held else buckets
    return {r["b"]: r["n"] for r in rows.groupBy(bucket_of(key, n).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}, n


def change_buckets(spark: SparkSession, path: str, rows: DataFrame, schema: t.StructType | str, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Replace the buckets of the rows' keys by ``change(old rows of these buckets, rows)``; which buckets were written.

    ``change`` must keep each row's key. Folders that the manifest no longer names stay for readers until ``vacuum``.
    """
    added, n = _touched(spark, path, rows, key, buckets)
    touched = sorted(added)
    if not touched:
        return []
    held, version = _manifest(spark, path), uuid.uuid4().hex[:12]
    parts = 1 + max(rows_new + held.get(b, ("", 0, n))[1] for b, rows_new in added.items()) // PART_ROWS
    new = change(read_buckets(spark, path, schema, touched), rows).withColumn("bucket", bucket_of(key, n))
    # a large bucket is written in parts, each by a task of its own
    new.repartition(min(n, len(touched)) * parts, F.col("bucket"), F.pmod(F.hash(F.col(key).cast("string")), F.lit(parts))).write.partitionBy("bucket").parquet(f"{path}/data/{version}")
    sizes = {r["bucket"]: r["n"] for r in spark.read.parquet(f"{path}/data/{version}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not set(sizes) <= set(touched):
        raise ValueError("a change must keep the keys of its rows")
    rest = {b: v for b, v in held.items() if b not in touched}
    entries = [(b, *v) for b, v in rest.items()] + [(b, f"{version}/bucket={b}", c, n) for b, c in sizes.items()]
    replace_table(spark.createDataFrame(sorted(entries), MANIFEST).coalesce(1), f"{path}/manifest")
    return touched


def upsert_buckets(spark: SparkSession, path: str, batch: DataFrame, schema: t.StructType | str, key: str = "obligation_id", buckets: int = BUCKETS) -> list[int]:
    """Rows of the batch replace those with the same key; which buckets were written."""
    from statuta.operators.register import upsert

    return change_buckets(spark, path, batch, schema, key, lambda old, new: upsert(old, new, (key,)), buckets)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that the manifest does not name; how many went. Not while others still read an older manifest."""
    named = {v[0] for v in _manifest(spark, path).values()}
    fs, data = _fs(spark, f"{path}/data")
    gone = 0
    for version in fs.listStatus(data) if fs.exists(data) else []:
        folders = [f.getPath() for f in fs.listStatus(version.getPath()) if f.isDirectory()]
        dead = [f for f in folders if f"{version.getPath().getName()}/{f.getName()}" not in named]
        if len(dead) == len(folders):
            fs.delete(version.getPath(), True)
        else:
            for f in dead:
                fs.delete(f, True)
        gone += len(dead)
    return gone
