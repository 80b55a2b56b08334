"""Shortest-pack-first packing of tokenised documents over the histogram of their lengths.

Documents are cut into pieces of at most ``max_len`` tokens. Only the histogram of piece lengths (at most
``max_len`` rows, whatever the corpus) comes to the driver; there, lengths are placed longest first, each
into the pattern that is shortest so far, and pattern counts are split where a length has fewer pieces than
the pattern has copies. Patterns are joined back to the pieces by the rank of a piece within its length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm.common import materialize

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_CODERS: dict[tuple[int, int, int], ChunkIds] = {}


class ChunkIds(dict):
    """Token ids (little-endian uint32 bytes) of space-separated chunks, each coded once and remembered.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks in
    order. Chunks of ASCII and Latin-1 letters are cut further, just where the tokenizer's own split cuts
    them; all others go through the whole tokenizer. What is remembered is bounded in bytes, not in entries:
    a chunk of more than ``longest`` bytes is never kept, and when half the bound is full, what was not met since
    the last time goes.
    """

    #: Bytes of an entry of a dict besides its key's and value's characters.
    overhead = 170
    longest = 48

    plain = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
    parts = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

    def __init__(self, tokenizer_json: str, most_bytes: int = 64_000_000, parts_bytes: int = 96_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_str(tokenizer_json)
        self.bytes_as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.most_bytes, self.parts_bytes, self.part_ids, self.held, self.held_parts = most_bytes, parts_bytes, {}, 0, 0
        self.before: dict[bytes, bytes] = {}
        self.parts_before: dict[str, bytes] = {}

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.of_chunk(chunk.decode("utf-8"))
        if len(chunk) <= self.longest:
            self.held += len(chunk) + len(ids) + self.overhead
            if self.held > self.most_bytes // 2:
                self.before, self.held = dict(self), 0
                self.clear()
            self[chunk] = ids
        return ids

    def of_chunk(self, text: str) -> bytes:
        if self.plain.fullmatch(text) and "<|" not in text:
            return b"".join([self.part_ids.get(p) or self.of_part(p) for p in self.parts.findall(text.lower())])
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_part(self, part: str) -> bytes:
        ids = self.parts_before.get(part)
        if ids is None:
            letters = part if part.isascii() else self.bytes_as_letters(part)[0][0]
            ids = np.asarray([t.id for t in self.whole.model.tokenize(letters)], dtype="<u4").tobytes()
        if len(part) <= self.longest:
            self.held_parts += len(part) + len(ids) + self.overhead
            if self.held_parts > self.parts_bytes // 2:
                self.parts_before, self.part_ids, self.held_parts = self.part_ids, {}, 0
            self.part_ids[part] = ids
        return ids


def chunk_encoder(tokenizer_json: str, most_bytes: int = 64_000_000, parts_bytes: int = 96_000_000):
    """A function text -> token ids as little-endian uint32 bytes; a worker keeps what it has learned."""
    key = (zlib.crc32(tokenizer_json.encode()), most_bytes, parts_bytes)
    known = _CODERS.get(key)
    if known is None:  # an empty one is kept as well, so no truth test; one tokenizer at a time
        _CODERS.clear()
        known = _CODERS[key] = ChunkIds(tokenizer_json, most_bytes, parts_bytes)
    return lambda text: b"".join(map(known.__getitem__, text.encode("utf-8", "replace").split()))


def tokenize_pieces(docs: DataFrame, tokenizer_json: str, max_len: int = 4096, end_id: int = 2, remembered: tuple[int, int] = (64_000_000, 96_000_000)) -> DataFrame:
    """Pieces of every document: ids of the text, then ``end_id``, cut every ``max_len`` tokens.

    ``remembered`` bounds the bytes of chunks and of parts that a worker keeps; it changes no result.
    """
    coder = docs.sparkSession.sparkContext.broadcast(tokenizer_json)  # one vocabulary file, a few MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = chunk_encoder(coder.value, *remembered), np.asarray([end_id], dtype="<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows)) or [()] * 5], names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                for at in range(0, n, max_len):
                    part = ids[4 * at : 4 * (at + max_len)]
                    rows.append((doc_id, at, len(part) // 4, zlib.crc32(part), n))
                if len(rows) >= 4096:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], max_len: int = 4096) -> list[tuple[int, int, tuple]]:
    """Patterns as (copies, tokens used, chain), a chain being (parent chain, length, offset) or None.

    Lengths go longest first. A length goes to the pattern with the most room; if it has fewer pieces left
    than the pattern has copies, the rest of the copies stay as they were. Where nothing has room, new
    patterns begin, each with one piece.
    """
    open_packs: list[tuple[int, int, int, tuple | None]] = []  # used, order, copies, chain
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if open_packs and open_packs[0][0] + length <= max_len:
                used, _, copies, chain = heapq.heappop(open_packs)
                take = min(copies, left)
                if take < copies:
                    order += 1
                    heapq.heappush(open_packs, (used, order, copies - take, chain))
            else:
                fit = max_len // length
                used, take, chain = 0, -(-left // fit), None
            order += 1
            heapq.heappush(open_packs, (used + length, order, take, (chain, length, used)))
            left -= take
    return [(copies, used, chain) for used, _, copies, chain in open_packs]


def slots_of(patterns: list[tuple[int, int, tuple]]) -> np.ndarray:
    """Rows (length, first rank, first sequence id, offset), sorted; ranks count the pieces of a length."""
    rows, taken, base = [], {}, 0
    for copies, _, chain in patterns:
        while chain is not None:
            chain, length, offset = chain
            first = taken.get(length, 0)
            rows.append((length, first, base, offset))
            taken[length] = first + copies
        base += copies
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 4)


def ranked_within_length(pieces: DataFrame, buckets: int = 64) -> DataFrame:
    """Add ``rank``, gapless from 0 within each length, without sorting a whole length in one task.

    Pieces of a length are dealt over ``buckets`` by a hash; a piece's rank is its place in the bucket plus
    the sizes of the buckets before.
    """
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    return salted.withColumn("place", place).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("place") - 1).drop("bucket", "place", "first")


def pack(docs: DataFrame, tokenizer_json: str, max_len: int = 4096, end_id: int = 2, bucket_rows: int = 50_000, remembered: tuple[int, int] = (64_000_000, 96_000_000)) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``max_len`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text
    is an empty one and gives the single piece of ``end_id``; repeated rows are packed each on its own; null
    ids pass through; further columns of ``docs`` are ignored; an empty table gives no rows. Documents longer
    than ``max_len`` are cut, so very long texts need no special case. ``remembered`` bounds the bytes of
    chunks and of parts that a worker keeps; it changes no result.
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer_json, max_len, end_id, remembered), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = slots_of(shortest_pack_first(histogram, max_len))
    buckets = max(16, -(-max(histogram.values(), default=1) // bucket_rows))
    shared = docs.sparkSession.sparkContext.broadcast(slots)  # its size depends on max_len, not on the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (shared.value[:, 0] << 45) | shared.value[:, 1] if len(shared.value) else np.empty(0, np.int64)
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            length, rank = cols["length"].to_numpy(zero_copy_only=False), cols["rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 45) | rank, side="right") - 1
            hit = shared.value[at]
            yield pa.RecordBatch.from_arrays(
                [cols[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 3])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = ranked_within_length(pieces, buckets)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(place, PIECE_SCHEMA + ", sequence_id long, offset long")
