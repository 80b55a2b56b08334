"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items are dealt into blocks of about ``block_words`` words by a hash, and each block's automaton is built over the
items' words in a task of its own and written to the shared scratch folder. Documents stream through one
automaton at a time: each position carries the length of the longest item passage that ends there, and
passages of a whole window are hits. A task and the driver hold one block at a time (at the default below 100 MB in a worker), however large the item
table is. With several blocks the texts are written once with a tag and read once for each block; only tags, spans and item ids of
documents with hits are written a block, and these meet the documents at the end.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.common import materialize

#: The automaton that a worker holds, by the checksum of its bytes; never more than one.
_HELD: dict[int, SuffixAutomaton] = {}
#: Lower-cases A-Z and blanks all other ASCII characters that belong to no word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the items of every window-long passage."""

    def __init__(self, window: int = 13):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.owners: dict[int, set[str]] = defaultdict(set)
        self.short: dict[tuple[int, ...], set[str]] = {}

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, known, word)
        new, at = self._state(self.length[last] + 1), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            target = self.next[at][word]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, target, word)
        return new

    def _split(self, at: int, target: int, word: int) -> int:
        copy = self._state(self.length[at] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while at >= 0 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list[bytes]) -> list[int]:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        last = 0
        for w in ids:
            last = self._extend(last, w)
        return ids

    def finish(self, items: list[tuple[str, list[bytes]]]) -> SuffixAutomaton:
        """Add all items, then note which items own each passage of a window (an item that is shorter is one window)."""
        coded = [(name, self.add(words)) for name, words in items if words]
        for name, ids in coded:
            if len(ids) < self.window:
                self.short.setdefault(tuple(ids), set()).add(name)
        for name, ids in coded:
            if len(ids) >= self.window:
                state = length = 0
                for w in ids:
                    state, length = self.step(state, length, w)
                    if length >= self.window:
                        self.owners[self.at_window(state)].add(name)
        self.short_lengths = sorted({len(k) for k in self.short})
        self.least = min([self.window, *self.short_lengths])
        return self

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest passage that ends with ``word`` after the passage (state, length)."""
        while word not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][word], length + 1

    def at_window(self, state: int) -> int:
        """The state that holds the window-long suffix of a passage."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, end) that windows cover, in order and disjoint, and the items found.

        Only runs of words that occur in some item can hold a window, so all else is passed over.
        """
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        for first, end in edges.reshape(-1, 2).tolist():
            if end - first < self.least:
                continue
            run, state, length = ids[first:end].tolist(), 0, 0
            for i, w in enumerate(run):
                state, length = self.step(state, length, w)
                covered = 0
                if length >= self.window:
                    names |= self.owners.get(self.at_window(state), set())
                    covered = self.window
                for n in self.short_lengths:
                    if n <= length and (found := self.short.get(tuple(run[i + 1 - n : i + 1]))):
                        names |= found
                        covered = max(covered, n)
                if covered:
                    start, stop = first + i + 1 - covered, first + i + 1
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, stop))
        return spans, names


def automata(items: DataFrame, window: int = 13, block_words: int = 200_000) -> DataFrame:
    """Rows (block, automaton): the pickled automaton of each block of items (item_id, text), written once.

    Items are dealt by a hash of id and text into as many blocks as make about ``block_words`` words each; one
    item is never cut. A null id counts as an empty one; an empty table makes no rows.
    """
    slim = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # an upper bound of the words: runs of characters that are neither space nor ASCII marks
    words = slim.agg(F.coalesce(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-words // block_words))

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["item_id"].to_pylist(), table["text"].to_pylist()))
        blob = pickle.dumps(SuffixAutomaton(window).finish([(name, words_of(text)) for name, text in rows]), 5)
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "automaton": pa.array([blob], pa.binary())})

    dealt = slim.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int"))
    return materialize(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"), "automata")


def held(blob: bytes) -> SuffixAutomaton:
    """The automaton of these bytes; the one that the worker held before goes."""
    key = zlib.crc32(blob)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = pickle.loads(blob)
    return _HELD[key]


SPANS = "array<struct<start:long,end:long>>"
_SPAN_KIND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _visited(rows: DataFrame, blob: bytes, text: str, hits_only: bool) -> tuple[DataFrame, object]:
    """``rows`` with n_words, spans and item_ids of one block's automaton, and its broadcast; with ``hits_only``, rows with hits."""
    shared = rows.sparkSession.sparkContext.broadcast(blob)
    names = [c for c in rows.columns if not (hits_only and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(shared.value)
        for batch in batches:
            n, all_spans, all_names, at = [], [], [], []
            for i, value in enumerate(batch.column(text)):
                words = words_of(value.as_py())
                found, owners = automaton.hits(words)
                if found or not hits_only:
                    at.append(i)
                    n.append(len(words))
                    all_spans.append([{"start": a, "end": b} for a, b in merged(found)])
                    all_names.append(sorted(owners))
            kept = [batch.column(c).take(pa.array(at, pa.int64())) if hits_only else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(all_spans, _SPAN_KIND), pa.array(all_names, pa.list_(pa.string()))], [*names, "n_words", "spans", "item_ids"])

    schema = T.StructType([*[rows.schema[c] for c in names], *T.StructType.fromDDL(f"n_words long, spans {SPANS}, item_ids array<string>").fields])
    return rows.mapInArrow(run, schema), shared


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of several blocks as one list, their items each once."""
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for part in parts for s in part])] for parts in batch.column("spans").to_pylist()]
        names = [sorted({x for part in parts for x in part}) for parts in batch.column("item_ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_tag"), batch.column("n_words"), pa.array(spans, _SPAN_KIND), pa.array(names, pa.list_(pa.string()))], ["_tag", "n_words", "spans", "item_ids"])


def found_in(rows: DataFrame, items: DataFrame, window: int, block_words: int, text: str = "text", count_words: bool = True) -> DataFrame:
    """Rows with n_words, spans and item_ids of the column ``text`` added. Without items the words are counted all the same.

    Without ``count_words``, n_words may be null where there is no hit. How often a text is written or moved: not at all with one
    block, and once with several. Documents meet the blocks' hits by a join that the planner chooses from the size of the written hits.
    """
    blocks = automata(items, window, block_words)
    numbers = sorted(r["block"] for r in blocks.select("block").collect())
    none = pickle.dumps(SuffixAutomaton(window).finish([]), 5)
    blob = lambda number: blocks.filter(F.col("block") == number).first()["automaton"]  # noqa: E731  of bounded size, see automata()
    if len(numbers) < 2:
        return _visited(rows, blob(numbers[0]) if numbers else none, text, False)[0]
    tagged = materialize(rows.withColumn("_tag", F.monotonically_increasing_id()), "tagged-for-blocks")
    parts = None
    for number in numbers:
        found, shared = _visited(tagged.select("_tag", text), blob(number), text, True)
        found = materialize(found, "block-hits")
        shared.destroy()
        parts = found if parts is None else parts.unionByName(found)
    kind = f"_tag long, n_words long, spans {SPANS}, item_ids array<string>"
    gathered = parts.groupBy("_tag").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("item_ids").alias("item_ids"))  # at most one row a block
    hits = materialize(gathered.select("_tag", "n_words", "spans", "item_ids").mapInArrow(_merge, kind), "hits")
    joined = tagged.join(hits, "_tag", "left")
    if count_words:
        counted = materialize(_visited(tagged.select("_tag", text), none, text, False)[0].select("_tag", F.col("n_words").alias("_n")), "word-counts")
        joined = tagged.drop(text).join(counted, "_tag").join(hits, "_tag", "left").withColumn("n_words", F.col("_n")).drop("_n")
    empty = {"spans": F.coalesce("spans", F.array().cast(SPANS)), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))}
    return joined.withColumns(empty).select(*[c for c in rows.columns if c in joined.columns], "n_words", "spans", "item_ids")


def scan(docs: DataFrame, items: DataFrame, window: int = 13, block_words: int = 200_000) -> DataFrame:
    """Per document: doc_id, n_words, spans (word places, end exclusive), item_ids (sorted as strings).

    A null or empty text has no words and no spans; repeated rows are scanned each on its own; very long texts
    are scanned whole; an empty item table finds nothing; an empty table gives no rows. Columns other than
    doc_id and text are not read and may have any name.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return found_in(slim, items, window, block_words).select("doc_id", "n_words", "spans", "item_ids")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame, coverage: int = 20) -> DataFrame:
    """Counts and verdict from ``scan``: contaminated where hit words are at least 1/``coverage`` of all words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((hit > 0) & (coverage * hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, coverage: int = 20, remove_spans: bool = False, block_words: int = 200_000) -> DataFrame:
    """Drop contaminated documents; with ``remove_spans``, cut hit spans out of the texts of the others.

    A document goes where hit words reach 1/``coverage`` of its words. All columns of ``docs`` stay as they
    are; without ``remove_spans`` so do all texts, with it n_chars, where there is such a column, follows a text that was cut.
    A null or empty text is never contaminated; repeated rows are judged each on its own; an empty item table drops nothing; an
    empty table stays empty. Columns may have any name, since they travel under names of their place.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    text = inner[names.index("text")]
    rows = docs.toDF(*inner)
    rows = found_in(rows.withColumn(text, F.col(text).cast("string")), items, window, block_words, text, count_words=False)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    kept = rows.filter(~F.coalesce((hit > 0) & (coverage * hit >= F.col("n_words")), F.lit(False)))
    if remove_spans:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [without(t.as_py(), [(s["start"], s["end"]) for s in spans]) if spans else t.as_py() for t, spans in zip(batch.column(text), batch.column("spans").to_pylist())]
                columns = {**dict(zip(batch.schema.names, batch.columns)), text: pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        kept = kept.select(*inner, "spans").mapInArrow(cut, kept.select(*inner, "spans").schema)
        if "n_chars" in names:
            place = names.index("n_chars")
            changed = F.length(text).cast(docs.schema[place].dataType)
            kept = kept.withColumn(inner[place], F.when(F.size("spans") > 0, changed).otherwise(F.col(inner[place])))
    return kept.withColumn(text, F.col(text).cast(docs.schema["text"].dataType)).select(*inner).toDF(*names)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "replace")
    folded, places, at = raw.translate(_FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")
