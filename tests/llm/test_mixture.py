"""Deleted interpolation against plain Python with its own expectation-maximisation over single tokens."""

import math
import random
from collections import Counter

import pytest

from statuta.llm import language_model as m


def bucket(n):
    return 0 if n == 0 else n.bit_length()


def test_weights_by_plain_expectation_maximisation(spark):
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(400)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    got = {r.doc_id: r.score for r in m.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), block_tokens=2000, bucket_keys=700).collect()}
    kind = {i: m.kind_of(i, 7, 2, 3) for i, _ in texts}
    pairs = {i: list(zip(["\n", *t.split()], [*t.split(), "\n"])) for i, t in texts}
    counts = {}
    for name, keep in (("all", (m.TRAIN, m.DELETED)), ("rest", (m.TRAIN,))):
        two = Counter(p for i, ps in pairs.items() if kind[i] in keep for p in ps)
        one = Counter()
        for (_, b), n in two.items():
            one[b] += n
        counts[name] = two, one, sum(one.values())
    zero = 1 / (len(counts["all"][1]) + 1)

    def estimates(which, a, b):
        two, one, n = counts[which]
        return bucket(one[a]), (two[a, b] / one[a] if one[a] else 0.0, one[b] / n, zero)

    held = [estimates("rest", a, b) for i, ps in pairs.items() if kind[i] == m.DELETED for a, b in ps]
    weights = {b: [0.5, 0.4, 0.1] for b, _ in held}
    for _ in range(400):
        sums = {b: [0.01] * 3 for b in weights}
        for b, f in held:
            parts = [w * x for w, x in zip(weights[b], f)]
            for k in range(3):
                sums[b][k] += parts[k] / sum(parts)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
    known = sorted(weights)
    for i, ps in pairs.items():
        want = 0.0
        for a, b in ps:
            own, f = estimates("all", a, b)
            w = weights.get(own) or weights[min(known, key=lambda x: (abs(x - own), x))]
            want += math.log10(sum(x * y for x, y in zip(w, f)))
        assert got[i] == pytest.approx(want, rel=0.002, abs=0.01)


def test_requests_are_only_for_ranges_with_keys(spark):
    texts = [(i, " ".join(f"x{i * 7 + k}" for k in range(20))) for i in range(60)]
    table = m.blocks(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), 7, 2, 3, 100)
    rows = m.requests(table, 1_000_000)
    keys = sum(len(r["keys"]) // 8 for r in rows.collect())
    assert rows.count() <= keys < 4000
    few = m.requests(table, 3)
    assert {r["bucket"] for r in few.collect()} == {0, 1, 2} and sum(len(r["keys"]) // 8 for r in few.collect()) == keys


def test_hard_rows_and_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "a b a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("block", "kind", "words", "answers", "gram", "totals")})
    got = m.score(df).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 3, 5] and len({r.train_tokens for r in got}) == 1
    assert m.score(df.limit(0)).count() == 0
