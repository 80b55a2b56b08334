"""Histogram sort: shards of near equal bytes in one global key order, with one exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side while a group of copies
that is larger than a shard is still cut, between two of its rows. Splitters are found by counting: each
round counts the exact bytes and rows below candidate boundaries in every partition, adds the counts up,
and places finer probes where a splitter is not within tolerance yet. Only counts per probe come to the
driver, a number set by the shards and not by the rows. With the splitters known, rows move once.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm.common import materialize

_HALF = 1 << 63


def _keys(probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit probes as two columns of signed 64-bit numbers."""
    high = np.asarray([(p >> 64) - _HALF for p in probes], dtype=np.int64)
    low = np.asarray([(p & (2 * _HALF - 1)) - _HALF for p in probes], dtype=np.int64)
    return high, low


def _bucket(high: np.ndarray, low: np.ndarray, at_high: np.ndarray, at_low: np.ndarray) -> np.ndarray:
    """For each row key, how many probes are not above it."""
    first, last = np.searchsorted(at_high, high, "left"), np.searchsorted(at_high, high, "right")
    out = last.copy()
    same = np.flatnonzero(last > first)  # the row's hash is itself a probe's: the second part decides
    for a in np.unique(first[same]):
        rows = same[first[same] == a]
        out[rows] = a + np.searchsorted(at_low[a : last[rows[0]]], low[rows], "right")
    return out


def bytes_below(rows: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe (sorted); rows has columns h, k and size."""
    shared = rows.sparkSession.sparkContext.broadcast(_keys(probes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value[0]) + 1
        size, rows_in = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = _bucket(b.column(0).to_numpy(), b.column(1).to_numpy(), *shared.value)
            rows_in += np.bincount(at, minlength=n)
            np.add.at(size, at, b.column(2).to_numpy())
        full = np.flatnonzero(rows_in)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows_in[full])], ["b", "bytes", "n"])

    counted = rows.select("h", "k", "size").mapInArrow(count, "b long, bytes long, n long").groupBy("b").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    size, n = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in counted.collect():  # a row for each probe at most
        size[r["b"]], n[r["b"]] = r["bytes"], r["n"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(n)[:-1].tolist()


def find_splitters(rows: DataFrame, shares: list[float], tolerance: float, probes_each: int = 31, rounds: int = 40) -> list[tuple[int, int, int]]:
    """For each share of the bytes, a boundary (key, bytes below, rows below) within ``tolerance`` bytes.

    Where a single row or key is left between two probes and weighs more than that, the nearer of its two sides
    is taken; a heavy row elsewhere in the table changes no boundary.
    """
    top = 1 << 128
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    known: dict[int, tuple[int, int]] = {0: (0, 0), top: (total, n)}
    order = [0, top]
    for _ in range(rounds):
        probes: set[int] = set()
        for share in shares:
            goal = share * total
            i = max(1, bisect.bisect_left(order, True, key=lambda p: known[p][0] >= goal))
            low, high = order[i - 1], order[i]
            near = min(abs(known[p][0] - goal) for p in (low, high))
            # a single row between two probes cannot be cut
            if near > tolerance and high - low > 1 and known[high][1] - known[low][1] > 1:
                step = max(1, (high - low) // (probes_each + 1))
                probes.update(range(low + step, high, step))
        if not probes:
            break
        new = sorted(probes)
        size, below = bytes_below(rows, new)
        known |= {p: (s, b) for p, s, b in zip(new, size, below)}
        order = sorted(known)
    out = []
    for share in shares:
        i = max(1, bisect.bisect_left(order, True, key=lambda p: known[p][0] >= share * total))
        sides = [p for p in order[i - 1 : i + 1] if p < top]  # the end of all keys is no key itself
        best = min(sides, key=lambda p: abs(known[p][0] - share * total))
        out.append((best, *known[best]))
    return out


def assign(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, pieces: int | None = None, size: Column | None = None, piece_rows: int = 1_000_000) -> DataFrame:
    """Shard and slot of every row: the columns of ``docs`` but its text, plus size, text_crc32, shard, slot.

    Bytes per shard are within ``tolerance`` of the mean, but for the weight of one row. Each shard is dealt out in ``pieces``
    ranges (where not given, as many as make about ``piece_rows`` rows each) whose row counts are known from the
    probes, so that slots are gapless from 0 though no task sorts a whole shard. A null text weighs as an empty one; null ids sort
    first; rows equal in text and doc_id have the same key and stay in one shard, so many of these may outweigh it;
    columns other than doc_id and text are not read and may have any name; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16 if size is None else size).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-_HALF)).alias("k"),
        ),
        "sizes",
    )
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = pieces or max(1, -(-n // (shards * piece_rows)))
    cuts = shards * pieces
    bounds = find_splitters(slim, [i / cuts for i in range(1, cuts)], tolerance * total / shards / 2)
    ends = [(0, 0, 0), *bounds]
    starts_of_shards = ends[::pieces]
    first_slot = [b[2] - starts_of_shards[i // pieces][2] for i, b in enumerate(ends)]
    shared = docs.sparkSession.sparkContext.broadcast(_keys([b[0] for b in bounds]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bucket(b.column("h").to_numpy(), b.column("k").to_numpy(), *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "piece"])

    schema = "doc_id " + slim.schema["doc_id"].dataType.simpleString() + ", size long, text_crc32 long, h long, k long, piece int"
    slot_table = F.array(*[F.lit(x).cast("long") for x in first_slot])
    moved = slim.mapInArrow(place, schema).repartitionById(cuts, F.col("piece"))  # a task for each piece
    inside = F.row_number().over(Window.partitionBy("piece").orderBy("h", "k", "size"))
    return moved.select("doc_id", "size", "text_crc32", (F.floor(F.col("piece") / pieces)).cast("int").alias("shard"), (F.get(slot_table, F.col("piece")) + inside - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.001, pieces: int | None = None, piece_rows: int = 1_000_000) -> None:
    """Write ``docs`` in the global key order, a folder ``shard=k`` for each shard; the rows move once, with all columns.

    A shard has a file for each of its ``pieces`` (see ``assign``), each written by a task of its own, in the order of their
    names. A null text weighs as an empty one; null ids sort first; repeated rows stay side by side; an empty table
    writes no shard. A column named shard cannot be written beside the folders' own and is an error.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column named shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.xxhash64(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-_HALF)).alias("k")]
    slim = materialize(docs.select(*key, (F.octet_length(text) + 16).cast("long").alias("size")), "sizes")
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    pieces = pieces or max(1, -(-n // (shards * piece_rows)))
    cuts = shards * pieces
    bounds = find_splitters(slim, [i / cuts for i in range(1, cuts)], tolerance * total / shards / 2)
    high, low = (a.tolist() for a in _keys([b[0] for b in bounds]))
    # how many boundaries are not above the row's key: a search in the sorted list of boundaries
    edges = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("k")) for h, k in zip(high, low)]).cast("array<struct<h:long,k:long>>")
    steps = F.sequence(F.lit(0), F.lit(max(0, len(high).bit_length() - 1)))
    own = F.col("key")
    not_above = lambda i: F.coalesce(F.get(edges, i) <= own, F.lit(False))
    piece = F.aggregate(F.reverse(steps), F.lit(0), lambda at, s: F.when(not_above(at + F.pow(F.lit(2), s).cast("int") - 1), at + F.pow(F.lit(2), s).cast("int")).otherwise(at))
    rows = docs.select(F.struct(*key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("piece", piece)
    moved = rows.repartitionById(cuts, F.col("piece")).sortWithinPartitions("piece", "key")
    moved.select("row.*", F.floor(F.col("piece") / pieces).cast("int").alias("shard")).write.partitionBy("shard").parquet(path)
