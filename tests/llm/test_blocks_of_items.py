"""Automata are built in tasks, one block at a time; spans go; rows of any shape pass."""

from collections import Counter

from pyspark.sql import functions as F

from statuta.llm.decontamination import automata, decontaminate, digest, held, scan

DIR = "/root/testdata/sf0.01"


def test_blocks_are_bounded_and_whole(spark):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    blocks = automata(items, 13, 300).collect()
    words = [len(held(r.automaton).vocabulary) for r in blocks]
    assert len(blocks) > 2 and max(words) < 1500
    one = scan(spark.read.parquet(f"{DIR}/documents.parquet"), items)
    many = scan(spark.read.parquet(f"{DIR}/documents.parquet"), items, block_words=600)
    assert digest(one).exceptAll(digest(many)).count() == digest(many).exceptAll(digest(one)).count() == 0
    assert digest(one).filter("n_hit > 0").count() > 3


def test_one_automaton_is_held_at_a_time(spark):
    from statuta.llm import decontamination as d

    a, b = (r.automaton for r in automata(spark.read.parquet(f"{DIR}/benchmark.parquet"), 13, 500).limit(2).collect())
    held(a), held(b)
    assert len(d._HELD) == 1


def test_spans_go_and_all_else_stays(spark):
    item = " ".join(f"item{i}" for i in range(20))
    filler = " ".join(f"word{i}" for i in range(900))
    rows = [(1, f"{filler} {item.upper()}, {filler}", 7), (2, f"short {item}", 7), (3, None, None), (4, "", 0), (5, filler, 1), (5, filler, 1), (None, f"{item} {filler}", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    df = df.withColumns({c: F.lit("x") for c in ("n_words", "spans", "item_ids", "row", "c0", "changed", "a.b")})
    bench = spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string")
    out = decontaminate(df, bench, remove_spans=True)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    got = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    joined = f"{filler} , {filler}"
    assert got == {(1, len(joined)): joined, (3, None): None, (4, 0): "", (5, 1): filler, (None, len(filler) + 1): " " + filler}
    assert Counter(r.doc_id for r in out.collect())[5] == 2
    assert {r.text for r in decontaminate(df, bench).filter("doc_id = 1").collect()} == {rows[0][1]}
    assert decontaminate(df.limit(0), bench).count() == 0 and decontaminate(df, bench.limit(0)).count() == len(rows)
    assert [r.n_words for r in scan(df, bench.limit(0)).orderBy("n_words").collect()][:2] == [0, 0]


def test_many_blocks_write_the_texts_once(spark):
    """Twenty blocks: the documents that stay are those of one block, and less than twice the input is written."""
    import os

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    base = spark.conf.get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet"))
    one = decontaminate(docs, items, remove_spans=True)
    before = size()
    words = 40 * items.count()
    many = decontaminate(docs, items, remove_spans=True, block_words=max(1, words // 20))
    written = size() - before - sum(len(r.automaton) for r in automata(items, 13, max(1, words // 20)).collect())
    assert automata(items, 13, max(1, words // 20)).count() >= 15
    assert written < 2 * os.path.getsize(f"{DIR}/documents.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(one) == key(many)
