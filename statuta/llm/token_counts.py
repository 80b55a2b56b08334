"""Count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates all vocabulary pieces that end at each character; dynamic programming over the
characters carries the best score and the number of pieces, without building the pieces themselves. Ties go
the way of the tokenizer: a later candidate replaces an earlier one only with a higher score, so of equal
segmentations the one whose last piece is longest stays. A character without a piece of its own costs the
least score of the vocabulary less 10; runs of such characters are one unknown piece, or their bytes where
the vocabulary has byte pieces. Control, unknown and byte pieces never match text: ``<s>`` in a text is three characters.

White space: each space begins a new word and is its first character (U+2581), which every text begins with.
No piece holds that character anywhere but at its beginning or in runs of it alone, so words are scored on
their own; words are remembered within a bound of bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: What an unknown character costs below the least score of the vocabulary (fixed by the tokenizer).
UNKNOWN_PENALTY = 10.0
_COUNTERS: dict[int, WordCounts] = {}


class WordCounts(dict):
    """(pieces, unknown pieces, score) of words, remembered up to ``most_bytes``; words of over ``longest`` characters are not kept.

    ``special`` names the pieces that are no text (control pieces); the piece at ``unknown`` and, where the
    vocabulary has all 256, the byte pieces are none either.
    """

    longest, overhead = 32, 330

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, byte_pieces: bool = True, special: Collection[str] = (), most_bytes: int = 160_000_000):
        import ahocorasick

        super().__init__()
        self.most_bytes, self.held = most_bytes, 0
        byte_names = {f"<0x{b:02X}>" for b in range(256)}
        self.bytes_known = byte_pieces and byte_names <= {p for p, _ in pieces}
        no_text = {*special, *(byte_names if self.bytes_known else ())}
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece and i != unknown and piece not in no_text:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> tuple[int, int, float]:
        out = self.count(word)
        if len(word) <= self.longest:
            self.held += len(word) + self.overhead
            if self.held > self.most_bytes:
                self.clear()
                self.held = 0
            self[word] = out
        return out

    def count(self, word: str) -> tuple[int, int, float]:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        if n and len(self.automaton):
            for end, match in self.automaton.iter(word):
                ending[end + 1].append(match)
        score, pieces, unknown, open_run = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best = None
            single = False
            for length, value in sorted(ending[end], reverse=True):
                single |= length == 1
                start = end - length
                total = score[start] + value
                if best is None or total > best:
                    best = total
                    pieces[end], unknown[end], open_run[end] = pieces[start] + 1, unknown[start], False
            if not single:
                total = score[end - 1] + self.unknown_score
                if best is None or total > best:
                    best = total
                    size = len(word[end - 1].encode("utf-8", "replace")) if self.bytes_known else 0 if open_run[end - 1] else 1
                    pieces[end] = pieces[end - 1] + size
                    unknown[end] = unknown[end - 1] + (0 if open_run[end - 1] else 1)
                    open_run[end] = True
            score[end] = best
        return pieces[n], unknown[n], score[n]


def words_of(text: str) -> list[str]:
    """The words of a text, each with its mark; a text that begins with a space has its first mark already."""
    words = [MARK + w for w in text.replace(MARK, " ").split(" ")] if text else []
    return words[1:] if words and words[0] == MARK else words


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], byte_pieces: bool = True, special: Collection[str] = ()) -> DataFrame:
    """Per document: doc_id, n_tokens, n_unknown, score of the best segmentation.

    ``pieces`` is the vocabulary in id order, the unknown piece first, sent to all tasks; its size does not follow
    the corpus. ``special`` are the control pieces, which match no text. Null and empty texts have no tokens and
    score 0; repeated rows count each on its own; very long texts are only many words; columns other than doc_id and text
    are not read and may have any name; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, sorted(special)))
    key = zlib.crc32(repr((pieces, byte_pieces, sorted(special))).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _COUNTERS.get(key)
        if known is None:
            _COUNTERS.clear()
            known = _COUNTERS[key] = WordCounts(shared.value[0], byte_pieces=byte_pieces, special=shared.value[1])
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = list(map(known.__getitem__, words_of(text.as_py() or "")))
                n, u, s = zip(*found) if found else ((), (), ())
                rows.append((sum(n), sum(u), float(sum(s))))
            n, u, s = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(u, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "n_tokens", "n_unknown", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_unknown long, score double")


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a vocabulary file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def control_pieces_of(model_file: str) -> list[str]:
    """The pieces of a vocabulary file that stand for no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i)]
