"""SQL of the training-data queries, whole span results, skew, lost executors' prerequisites, general interfaces."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from statuta.llm import queries
from statuta.llm.oracles import ORACLES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(rel.select(", ".join(columns)).fetchall())


def brute_secret_spans(t, scope=400):
    from statuta.llm import secret_scan as S

    find = lambda p: list(re.finditer(p, t))
    assign = find(S.ASSIGN)
    base = [(m.start(), 0, m.end()) for m in assign if len(m[1]) >= 12]
    base += [(m.start(), 1, m.end()) for m in find(S.ACCESS) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in find(S.HEX)]
    weak = [(m.start(), 3, m.end()) for m in assign if 6 <= len(m[1]) < 12]
    if "AKIA" in t or "://" in t:
        weak += [(m.start(), 3, m.end()) for m in find(S.BARE_KEY)]
    ends = [(m.start(), 4, m.end()) for m in find(S.ENDPOINT)]
    roles = [(s, 1) for s in base if s[1] == 1] + [(s, 2) for s in base if s[1] != 1] + [(s, 2) for s in weak] + [(s, 3) for s in ends]
    near = lambda s, own: any(r != own and max(s[0] - x[2], x[0] - s[2]) <= scope for x, r in roles)
    more = {s for s in weak if near(s, 2)} | {s for s in ends if near(s, 3)}
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + sorted(more)))


def test_whole_secret_spans(spark):
    import random

    from statuta.llm.secret_scan import scan

    rng = random.Random(5)
    parts = ["AKIA" + "A1B2C3D4E5F6G7H8", "password=abc1234", "token: 'abcdefghij12345'", "https://api.example.com/v1", "q" * 20 + "Zz0+" * 5, "secret = x", "0123456789abcdef01", "plain words here é ß", "AKIA1", "jdbc:mysql://db/x"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "\n", " filler" * rng.randint(1, 90) + " "]) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    got = {r.doc_id: r.spans for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_secret_spans(t) for i, t in enumerate(texts)}
    assert any("weak_secret" in s for s in got.values()) and any("endpoint" in s for s in got.values())


def test_long_and_hex_parts_link(spark):
    from statuta.llm.secret_scan import scan

    url = "https://db.example.com/x"
    texts = [
        f"connect {url} {'deadbeef' * 5}", f"token={'Ab1' * 170} {url}", f"{url}{'/ab1' * 900} key {'c0ffee' * 4}",  # a hex run, a part and an endpoint beyond the scope's length
        f"token={'Ab1' * 170} {'.' * 401}{url}", f"{url} alone", f"{'0123abcd' * 3} {'x ' * 199} {url}", f"{'0123abcd' * 3} {'x ' * 220} {url}",
    ]
    got = {r.doc_id: r.spans for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: brute_secret_spans(t) for i, t in enumerate(texts)}
    assert ["endpoint" in got[i] for i in range(7)] == [True, True, True, False, False, True, False]


def test_planted_parts_in_the_documents(spark):
    """Every third document gets parts at random places; all spans of all documents equal brute force."""
    import random

    from statuta.llm.secret_scan import scan

    rng = random.Random(6)
    parts = ["AKIA" + "A1B2C3D4E5F6G7H8", "password=abc1234", "https://api.example.com/v1", "Zz0+" * 10, "0123456789abcdef" * 2, "redis://cache:6379/0"]
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect():
        t = r.text or ""
        for _ in range(rng.randint(1, 5) if r.doc_id % 3 == 0 else 0):
            at = rng.randint(0, len(t))
            t = f"{t[:at]} {rng.choice(parts)} {t[at:]}"
        rows.append((r.doc_id, t))
    got = sorted((r.doc_id, r.spans) for r in scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect())
    assert got == sorted((i, brute_secret_spans(t)) for i, t in rows)
    assert sum("endpoint" in s for _, s in got) > 20 and sum("weak_secret" in s for _, s in got) > 20


def test_many_spans_in_one_text(spark):
    """Thousands of matches in one row take near linear time and keep their places."""
    from statuta.llm.pii import scan

    n = 4000
    text = " ".join(f"a{i}@b.example.org {i} 12" for i in range(n))
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    places = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("email")]
    assert r.n_email == n == len(places) and all(text[a:b] == f"a{i}@b.example.org" for i, (a, b) in enumerate(places))


def test_expectation_maximisation_finds_reliabilities(spark):
    import random

    from statuta.llm.pii import reliabilities

    true_rates = ((0.95, 0.05), (0.85, 0.2), (0.75, 0.35))  # all informative: with fewer the model is not identified
    rng, counts = random.Random(1), {}
    for _ in range(20000):
        true = rng.random() < 0.3
        v = tuple(int(rng.random() < (p if true else q)) for p, q in true_rates)
        counts[v] = counts.get(v, 0) + 1
    prior, rates = reliabilities(spark.createDataFrame([(*v, n) for v, n in counts.items()], "v1 int, v2 int, v3 int, n long").cache(), 60)
    assert prior == pytest.approx(0.3, abs=0.05)
    assert all(a == pytest.approx(p, abs=0.07) and b == pytest.approx(q, abs=0.07) for (a, b), (p, q) in zip(rates, true_rates))


def test_cascade_orders_by_rejection_per_cost_and_stops_early(spark):
    from statuta.llm.quality_rules import cascade, order_by_rejection_per_cost

    df = spark.range(400).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    # the second rule would fail the job wherever it is evaluated
    rules = {"never": lambda t: t == "x", "most": lambda t: ~t.rlike("7$"), "boom": lambda t: F.when(t.rlike("7$"), F.lit(False)).otherwise(F.raise_error(F.lit("reached")).cast("boolean"))}
    order = [r["rule"] for r in order_by_rejection_per_cost(df, {k: rules[k] for k in ("never", "most")})]
    assert order == ["most", "never"]
    kept = df.filter(cascade(F.col("text"), rules, ["most", "boom", "never"]).isNull())
    assert kept.count() == 40


def test_shards_are_written_whole(spark, tmp_path):
    from statuta.llm.sharding import write_shards

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    write_shards(docs, f"{tmp_path}/out", shards=5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.drop("shard").select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    sizes = [r.b for r in back.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("b")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) < 2 * docs.agg(F.max(F.octet_length("text"))).first()[0] + 32


def test_hot_lengths_are_ranked_in_parts(spark):
    from statuta.llm.packing import ranked_within_length

    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"), F.lit(1).cast("long").alias("doc_tokens"))
    for buckets in (1, 16):
        rows = ranked_within_length(df, buckets).groupBy("length").agg(F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("n"), F.count("*").alias("c")).collect()
        assert all(r.a == 0 and r.b + 1 == r.n == r.c for r in rows)


def test_no_local_checkpoint_and_no_python_on_native_paths(spark):
    for name in ("op2_secret_scans", "op5_pii", "op7_quality_rules"):
        plan = queries.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan), name
