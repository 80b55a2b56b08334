"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_operators import base_secrets, brute_components, brute_fingerprint, brute_hits, brute_quality, re

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = {str(r.item_id): re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, DIR)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality rules":
            assert 0 < len(after) < len(before)
            for i, t in before.items():
                q = brute_quality(t)
                if q[0] < 50 or 100 * q[4] > 50 * q[0]:
                    assert i not in after
        elif name == "near duplicates":
            values = [(i, brute_fingerprint(t)) for i, t in before.items()]
            root = brute_components(values, 4)
            assert set(after) == set(root.values())
        elif name == "decontamination":
            for i, t in before.items():
                words, hit, _ = brute_hits(t, items)
                assert (i in after) == (not (hit and 20 * len(hit) >= len(words)))
        elif name == "secret scans":
            assert set(after) == set(before) and not any(base_secrets(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not re.search("[0-9a-f]{16}|[Pp]assw|oken|ecret|AKIA|key", t))
        docs = spark.createDataFrame(out.toPandas(), out.schema)


def test_run(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.count() > 0 and max(Counter((r.doc_id, r.start) for r in got.collect()).values()) == 1


def test_hard_rows_through_all_stages(spark):
    """Nulls, blank and long texts, repeated rows and extra columns of clashing names through the whole chain; an empty table stays empty."""
    from pyspark.sql import functions as F

    from statuta.llm.common import materialize

    prose = lambda k, n=120: " ".join(f"word{(i * 7 + k * 13) % 997}{chr(97 + (i + k) % 26)}" for i in range(n))
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").first().text
    rows = [
        (1, None, None, 1), (2, "", "a", 0), (3, " \n\t ", "a", 4), (4, prose(4), "a", None), (5, prose(4), None, 5), (6, prose(6), "b", 9), (6, prose(6), "b", 9), (None, prose(8), "c", 1),
        (9, prose(9, 20_000), "c", 7), (10, "same three words " * 60, "c", 7), (11, prose(11) + " password=abcdefghijklmnop " + prose(12), "d", 1), (12, f"{prose(13, 20)} {item} {prose(14, 20)}", "d", 1), (13, f"{prose(15, 2000)} {item} {prose(16, 2000)}", "d", 1),
    ]
    names = ("tag", "row", "fp", "spans", "item_ids", "n_words", "kept", "rule", "_tag", "start", "length")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({n: F.lit(n) for n in names})
    empty, columns, left = docs.limit(0), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), "hard-rows")
        empty = materialize(stage(spark, empty, DIR), "no-rows")
        assert empty.count() == 0
        if name != "packing":
            assert docs.columns == empty.columns == columns and docs.filter(" or ".join(f"{n} <> '{n}'" for n in names)).count() == 0
            left[name] = Counter(r.doc_id for r in docs.collect())
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert left["quality rules"] == Counter([4, 5, 6, 6, None, 9, 11, 12, 13])
    assert left["near duplicates"] == Counter([4, 6, None, 9, 11, 12, 13])
    assert left["decontamination"] == left["secret scans"] == Counter([4, 6, None, 9, 11, 13])
    assert "abcdefghijklmnop" not in texts[11] and item not in texts[13] and texts[9] == prose(9, 20_000)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(left["secret scans"]) and max(Counter((r.sequence_id, r.offset) for r in pieces).values()) == 1
