"""Control, unknown and byte pieces of a vocabulary match no text."""

from statuta.llm import queries
from statuta.llm.token_counts import WordCounts, count_tokens


def test_control_pieces_are_no_text(spark):
    pieces, special = queries.unigram_pieces(), queries.control_pieces()
    assert {"<unk>", "<s>", "</s>"} <= set(special)
    texts = ["a<s>b", "a<x>b", "<0x0A>", "<0xZA>", "</s>", "<unk>", "", None, "x<s>" * 3]
    got = [r.n_tokens for r in count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), pieces, special=special).collect()]
    plain = [(p, s) for p, s in pieces if p not in special and not (p.startswith("<0x") and p.endswith(">"))]
    least = min(s for _, s in pieces)

    def brute(text):
        """Best segmentation by trying all cuts; characters without a piece cost the least score less 10 and give their bytes."""
        table, best = dict(plain), [(0.0, 0)]
        for end in range(1, len(text) + 1):
            found = None
            for start in range(end):  # the longest last piece first: only a better one replaces it
                if text[start:end] in table and (found is None or best[start][0] + table[text[start:end]] > found[0]):
                    found = best[start][0] + table[text[start:end]], best[start][1] + 1
            if text[end - 1] not in table and (found is None or best[end - 1][0] + least - 10 > found[0]):
                found = best[end - 1][0] + least - 10, best[end - 1][1] + len(text[end - 1].encode())
            best.append(found)
        return best[-1][1]

    assert got == [brute("▁" + t) if t else 0 for t in texts]


def test_a_vocabulary_of_control_pieces_only():
    w = WordCounts([("<unk>", 0.0), ("<s>", 0.0)], special=["<s>"])
    assert w.count("<s>") == (1, 1, -30.0)


def test_memory_is_bounded_in_bytes():
    w = WordCounts([("<unk>", 0.0), ("a", -1.0)], most_bytes=40_000)
    for i in range(2000):
        w[f"w{i}"]
    w["a" * 100]
    assert len(w) < 120 and "a" * 100 not in w
