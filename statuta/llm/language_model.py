"""Language-model scoring by deleted interpolation.

A text's tokens are its lower-cased words and one end. A token's probability mixes the maximum-likelihood
estimates of order two, one and zero, with weights that depend on how often the context was seen (buckets
of powers of two). The weights are learned by expectation-maximisation on held-out counts: one fold of the
training documents, against the estimates of the other folds. The estimates that score are those of all training documents.

How it runs: each task writes its documents as blocks of word numbers with the block's own dictionary.
A block then asks for the counts of its distinct n-grams: requests go out by n-gram (a hash range each), where all
blocks' counts are added up, and the totals come back to the blocks. An n-gram moves once per block however
often it occurs there, so no frequent word or pair makes a large task, and no table of the whole
vocabulary is ever held in one place. N-grams are known by 64-bit hashes.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import materialize

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for the end; no word holds white space.
_END = b"\n"
TRAIN, DELETED, HELD_OUT = 0, 1, 2
BLOCK_SCHEMA = "block long, kind int, n_tokens long, doc_ids array<long>, ends array<int>, words binary, hashes binary"
#: Held-out tokens are summed up in cells of a quarter octave of each estimate (at most 26 * 161 * 161 rows reach the driver).
STEP, LEAST_LOG, BUCKETS = 0.25, -40, 26


def kind_of(doc_id: int | None, folds: int, held_out: int, deleted: int) -> int:
    rest = zlib.crc32(str(doc_id).encode()) % folds if doc_id is not None else -1
    return HELD_OUT if rest == held_out else DELETED if rest == deleted else TRAIN


def pack_ids(ids: np.ndarray) -> bytes:
    """Word numbers as deflated byte planes."""
    return zlib.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_ids(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def pack_counts(values: np.ndarray) -> bytes:
    kind = "<u4" if not len(values) or values.max() < 1 << 32 else "<u8"
    return (b"4" if kind == "<u4" else b"8") + zlib.compress(values.astype(kind).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), "<u" + data[:1].decode()).astype(np.float64)


class _Block:
    """Documents of one kind, as word numbers of a dictionary of their own; number 0 is the end."""

    def __init__(self, kind: int):
        self.kind, self.doc_ids, self.parts, self.n = kind, [], [], 0
        self.numbers = defaultdict(count().__next__)
        self.numbers[_END]

    def add(self, doc_id: int | None, text: str | None) -> None:
        words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
        words.append(_END)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.doc_ids.append(doc_id)
        self.n += len(words)

    def row(self) -> tuple:
        from xxhash import xxh64_intdigest

        hashes = np.fromiter((xxh64_intdigest(w, 7) for w in self.numbers), np.uint64, len(self.numbers))
        ends = np.cumsum([len(p) for p in self.parts]).tolist()
        name = int.from_bytes(os.urandom(8), "little") >> 1
        return name, self.kind, self.n, self.doc_ids, ends, pack_ids(np.concatenate(self.parts)), hashes.astype("<u8").tobytes()


def blocks(docs: DataFrame, folds: int, held_out: int, deleted: int, block_tokens: int) -> DataFrame:
    """The documents as blocks of about ``block_tokens`` tokens, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("block", pa.int64()), ("kind", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("words", pa.binary()), ("hashes", pa.binary())]
        )
        emit = lambda b: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(b.row(), schema.types)], schema=schema)
        held = {k: _Block(k) for k in (TRAIN, DELETED, HELD_OUT)}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                kind = kind_of(doc_id, folds, held_out, deleted)
                held[kind].add(doc_id, text.as_py())
                if held[kind].n >= block_tokens:
                    yield emit(held[kind])
                    held[kind] = _Block(kind)
        for b in held.values():
            if b.n:
                yield emit(b)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCK_SCHEMA), "blocks")


def grams_of(words: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous word number of each token, the place of its pair among the distinct pairs, and their keys."""
    previous = np.empty_like(words)
    previous[1:] = words[:-1]  # a text's last token is the end, which is also what a text begins after
    previous[0] = 0
    size = len(hashes)
    codes, place = np.unique(previous * size + words, return_inverse=True)
    a, b = hashes[codes // size], hashes[codes % size]
    with np.errstate(over="ignore"):
        key = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b << np.uint64(31)) | (b >> np.uint64(33)))
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
    return previous, place, key


def hash_range(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` near equal ranges of its upper 32 bits each key lies in; sorted keys give sorted ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def requests(table: DataFrame, n_buckets: int) -> DataFrame:
    """A row for each block, order and hash range: the block's distinct n-grams there and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, kind, ends, words, hashes in zip(*(batch.column(n).to_pylist() for n in ("block", "kind", "ends", "words", "hashes"))):
                ids, h = unpack_ids(words), np.frombuffer(hashes, "<u8")
                _, place, pair_keys = grams_of(ids, np.asarray(ends), h)
                rows = []
                for gram, keys, n in ((1, h, np.bincount(ids, minlength=len(h))), (2, pair_keys, np.bincount(place, minlength=len(pair_keys)))):
                    order = np.argsort(keys, kind="stable")
                    k, c = keys[order], n[order].astype("<u4")
                    full, starts = np.unique(hash_range(k, n_buckets), return_index=True)  # only ranges that the block has keys in
                    rows += [(gram, i, block, kind, k[a:b].tobytes(), c[a:b].tobytes()) for i, a, b in zip(full.tolist(), starts.tolist(), [*starts[1:].tolist(), len(k)])]
                g, i, bl, ki, k, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g, pa.int32()), pa.array(i, pa.int32()), pa.array(bl, pa.int64()), pa.array(ki, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())],
                    ["gram", "bucket", "block", "kind", "keys", "counts"],
                )

    return table.select("block", "kind", "ends", "words", "hashes").mapInArrow(run, "gram int, bucket int, block long, kind int, keys binary, counts binary")


def answer(t: pa.Table) -> pa.Table:
    """Totals of one hash range: for each block, the training counts of its n-grams in the order asked; with
    the deleted fold left out as well where the block is of that fold; and a row of sums (block null)."""
    gram, bucket = t["gram"][0].as_py(), t["bucket"][0].as_py()
    kinds = t["kind"].to_pylist()
    keys = [np.frombuffer(x.as_py(), "<u8") for x in t["keys"]]
    counts = [np.frombuffer(x.as_py(), "<u4") for x in t["counts"]]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sizes = np.asarray([len(k) for k in keys])
    kind = np.repeat(np.asarray(kinds), sizes)
    n = np.concatenate(counts).astype(np.float64)
    total = np.bincount(place, n * (kind != HELD_OUT), len(distinct))
    rest = total - np.bincount(place, n * (kind == DELETED), len(distinct))
    at, out = 0, []
    for block, k, size in zip(t["block"].to_pylist(), kinds, sizes.tolist()):
        p = place[at : at + size]
        out.append((block, pack_counts(total[p]), pack_counts(rest[p]) if k == DELETED else None, None, None, None))
        at += size
    out.append((None, None, None, int(total.sum()), int(rest.sum()), int((total > 0).sum())))
    b, x, y, s, r, v = zip(*out)
    return pa.table(
        {"gram": pa.array([gram] * len(out), pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "block": pa.array(b, pa.int64()), "totals": pa.array(x, pa.binary()), "rest": pa.array(y, pa.binary()), "n": pa.array(s, pa.int64()), "n_rest": pa.array(r, pa.int64()), "distinct": pa.array(v, pa.int64())}
    )


def token_counts(batch: pa.RecordBatch, column: str) -> Iterator[tuple]:
    """For each block: doc ids, ends, and for each token the counts of its context, itself and its pair."""
    for doc_ids, ends, words, hashes, parts in zip(*(batch.column(n).to_pylist() for n in ("doc_ids", "ends", "words", "hashes", "answers"))):
        ids, h, ends = unpack_ids(words), np.frombuffer(hashes, "<u8"), np.asarray(ends)
        previous, place, pair_keys = grams_of(ids, ends, h)
        found = {}
        for gram, keys in ((1, h), (2, pair_keys)):
            inside = np.concatenate([unpack_counts(p[column]) for p in sorted((p for p in parts if p["gram"] == gram), key=lambda p: p["bucket"])])
            back = np.empty(len(keys))
            back[np.argsort(keys, kind="stable")] = inside
            found[gram] = back
        yield doc_ids, ends, found[1][previous], found[1][ids], found[2][place]


def frequency_bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context not seen, else one more than the whole part of the base-2 logarithm of its count."""
    return np.minimum(np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def _level(p: np.ndarray) -> np.ndarray:
    """A probability's place on a logarithmic scale; 0 for a probability of 0."""
    return np.where(p > 0, np.clip(np.floor(np.log2(np.maximum(p, 1e-300)) / STEP) - LEAST_LOG / STEP + 1, 1, None), 0).astype(np.int64)


def learn_weights(cells: np.ndarray, zero: float, rounds: int = 400) -> np.ndarray:
    """Mixture weights (bucket x order 2, 1, 0) from held-out cells (bucket, n, sum of f2, sum of f1)."""
    weights = np.tile(np.asarray([0.5, 0.4, 0.1]), (BUCKETS, 1))
    if not len(cells):
        return weights
    bucket, n = cells[:, 0].astype(int), cells[:, 1]
    f = np.column_stack((cells[:, 2] / n, cells[:, 3] / n, np.full(len(n), zero)))
    for _ in range(rounds):
        part = weights[bucket] * f
        part *= (n / part.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(bucket, part[:, i], BUCKETS) for i in range(3)], axis=1) + np.asarray([0.01, 0.01, 0.01])
        new = sums / sums.sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-7
        weights = new
        if done:
            break
    seen = np.bincount(bucket, n, BUCKETS) > 0
    for b in np.flatnonzero(~seen):  # a bucket without held-out tokens takes the weights of the nearest that has some
        weights[b] = weights[np.flatnonzero(seen)[np.abs(np.flatnonzero(seen) - b).argmin()]]
    return weights


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, deleted: int = 3, block_tokens: int = 1_500_000, bucket_keys: int = 1_500_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the learned order-2 share.

    Documents learn unless crc32(doc_id as text) mod ``folds`` is ``held_out``; those where it is ``deleted`` also serve to learn the
    weights. base_score is the add-one unigram model's log10 probability of the text, score that of the
    interpolated model. A null or empty text is the end alone; null ids learn; repeated rows count each on
    its own; very long texts are only long blocks; an empty table gives no rows; other columns are not read.
    """
    table = blocks(docs, folds, held_out, deleted, block_tokens)
    tokens, n_blocks = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = max(8, -(-tokens // bucket_keys))
    asked = requests(table, n_buckets)
    schema = "gram int, bucket int, block long, totals binary, rest binary, n long, n_rest long, distinct long"
    # more tasks than hash ranges (and, below, than blocks), so that what a task reads stays the same however large
    # the corpus is; a block has at most as many requests as keys, so all of it is linear in the corpus
    answers = materialize(asked.repartition(4 * n_buckets, "gram", "bucket").groupBy("gram", "bucket").applyInArrow(answer, schema), "answers")
    n, n_rest, v = answers.filter("block is null and gram = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_rest", "distinct")]).first()
    zero = 1.0 / (v + 1)

    def joined(kinds: DataFrame, column: str) -> DataFrame:
        tasks = max(3 * n_blocks, 1)  # for both sides, so that few tasks meet more than one block
        got = answers.filter(f"block is not null and {column} is not null").repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("gram", "bucket", column)).alias("answers"))
        return kinds.repartition(tasks, "block").join(got, "block").select("doc_ids", "ends", "words", "hashes", "answers", "kind")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, context, word, pair in token_counts(batch, "rest"):
                f2, f1 = pair / np.maximum(context, 1), word / max(n_rest, 1)
                b = frequency_bucket(context)
                code, place = np.unique((b << 32) | (_level(f2) << 16) | _level(f1), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.bincount(place).astype(float)), pa.array(np.bincount(place, f2)), pa.array(np.bincount(place, f1))], ["code", "n", "f2", "f1"])

    held = joined(table.filter(F.col("kind") == DELETED), "rest").mapInArrow(cells, "code long, n double, f2 double, f1 double")
    # a row for each bucket and pair of levels at most, whatever the corpus
    summed = held.groupBy("code").agg(F.sum("n"), F.sum("f2"), F.sum("f1")).collect()
    weights = learn_weights(np.asarray([(r[0] >> 32, r[1], r[2], r[3]) for r in sorted(summed)], dtype=np.float64).reshape(-1, 4), zero)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, (doc_ids, ends, context, word, pair) in zip(batch.column("kind").to_pylist(), token_counts(batch, "totals")):
                w = weights[frequency_bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] * zero
                starts = np.concatenate(([0], ends[:-1]))
                size = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([kind == HELD_OUT] * size),
                        pa.array((ends - starts).astype(np.int64)),
                        pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                        pa.array([n] * size, pa.int64()),
                        pa.array(np.add.reduceat(np.log10((word + 1) / (n + v + 1)), starts)),
                        pa.array(np.add.reduceat(np.log10(p), starts)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined(table, "totals").mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
