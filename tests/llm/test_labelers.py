"""Weak supervision: what the labelers vote, the estimate and the classifier against plain Python, planted spans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from statuta.llm import pii

VOTES = {
    # kind, match, text before -> arithmetic, gazetteer, context
    ("account", "DE89370400440532013000", "iban "): "111",
    ("account", "DE88370400440532013000", "nothing "): "012",
    ("account", "XX89370400440532013000", "order "): "000",
    ("ssn", "123-45-6789", "his ssn is "): "121",
    ("ssn", "666-45-6789", ""): "022",
    ("ssn", "078-05-1120", "part "): "100",
    ("local_phone", "(212) 555-0199", "call "): "121",
    ("local_phone", "800-555-0199", "x "): "102",
    ("local_phone", "911-111-0199", "x "): "022",
    ("number", "4539 1488 0343 6468", "card number "): "011",
    ("number", "9939148803436468", "x "): "002",
    ("card", "4539148803436467", "x "): "112",
    ("email", "a.b@c.example.com", "mail "): "111",
    ("email", "a..b@c.example.zz9", "x "): "022",
    ("ip", "97.51.17.173", "host "): "111",
    ("ip", "1.2.3.4", "version "): "210",
    ("ip", "10.0.01.7", "x "): "002",
    ("phone", "+1 (212) 555-0199", "tel "): "111",
    ("phone", "+999 (21 55--0199", "x "): "002",
}


def test_votes(spark):
    rows = [(k, m, b + m, len(b), "".join(want)) for (k, m, b), want in VOTES.items()]
    df = spark.createDataFrame(rows, "kind string, m string, text string, start long, want string")
    for kind in sorted({r[0] for r in rows}):
        s = F.struct(F.col("start").alias("start"), (F.col("start") + F.length("m")).alias("end"), F.col("m").alias("match"))
        got = df.filter(F.col("kind") == kind).select("m", "want", F.concat(*[v.cast("string") for v in pii.votes(kind, s, F.col("text"), pii.CONTEXT, pii.GAZETTEER)]).alias("got"))
        assert all(r.got == r.want for r in got.collect()), got.collect()


def brute_estimate(rows, rounds):
    """The same model, one span at a time."""
    spans = [(k, v, known) for k, v, n, known in rows for _ in range(n)]
    share = {k: 0.5 for k, *_ in rows}
    rate = [[list(c) for c in pii.FIRST_RATES] for _ in rows[0][1]]

    def p_of(k, v, known):
        yes, no = share[k], 1 - share[k]
        for i, x in enumerate(v):
            if x != 2:
                yes, no = yes * rate[i][1][x], no * rate[i][0][x]
        return 1.0 if known else yes / (yes + no)

    for _ in range(rounds):
        p = [p_of(*s) for s in spans]
        share = {k: (sum(q for q, s in zip(p, spans) if s[0] == k) + 0.5) / (sum(s[0] == k for s in spans) + 1) for k in share}
        rate = [
            [[(sum((q if true else 1 - q) for q, s in zip(p, spans) if s[1][i] == x) + pii.FIRST_RATES[true][x]) / (sum(q if true else 1 - q for q, s in zip(p, spans) if s[1][i] != 2) + 1) for x in range(2)] for true in (0, 1)]
            for i in range(len(rate))
        ]
    return share, rate, [p_of(k, v, known) for k, v, n, known in rows]


def test_estimate_against_plain_python():
    rng = random.Random(4)
    rows = [(rng.choice("ab"), tuple(rng.randrange(3) for _ in range(3)), rng.randint(1, 9), rng.random() < 0.2) for _ in range(40)]
    share, rates, true = pii.estimate(rows, 12)
    want = brute_estimate(rows, 12)
    assert share == pytest.approx(want[0]) and true == pytest.approx(want[2])
    assert all(rates[i][c] == pytest.approx(want[1][i][c]) for i in range(3) for c in (0, 1))
    assert pii.estimate([])[2] == [] and pii.train({}) == {}


def test_classifier_is_at_the_optimum():
    rng = random.Random(6)
    table = {f"{rng.choice(['ssn', 'number'])}|{rng.randrange(3)}|{rng.randrange(3)}|{rng.randrange(3)}|{rng.randint(9, 12)}|{rng.choice('sp')}": (rng.randint(1, 30), rng.random()) for _ in range(60)}
    w = pii.train(table)
    for f in w:  # the slope of the penalised likelihood is zero in each direction
        slope = -w[f]
        for p, (n, y) in table.items():
            if f in pii.features_of(p):
                slope += n * (y - 1 / (1 + math.exp(-sum(w[g] for g in pii.features_of(p)))))
        assert slope == pytest.approx(0, abs=1e-6)


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    return f"DE{98 - int(body + '131400') % 97:02d}{body}"


def test_planted_spans_are_added_and_decoys_are_not(spark):
    rng = random.Random(8)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, want = [], {}
    for i in range(600):
        kind = ("account", "local_phone", "ssn", "decoy number", "decoy account", "base", "none")[i % 7]
        span = {
            "account": lambda: iban(rng),
            "local_phone": lambda: f"{rng.choice('23456789')}{rng.choice('02345678')}{rng.choice('2345')}-{rng.choice('23456789')}0{digit(1)}-{digit(4)}",
            "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
            "decoy number": lambda: "99" + digit(12),
            "decoy account": lambda: f"XX{digit(2)}{digit(18)}",
            "base": lambda: f"u{i}@mail.example.com and +1 (212) 555-{digit(4)} at 97.51.17.{i % 250}",
            "none": lambda: "words",
        }[kind]()
        words = {"account": "the iban is", "local_phone": "call me at", "ssn": "my ssn is"}.get(kind, "order") if i % 2 else "and"
        rows.append((i, f"some text {words} {span} more text"))
        want[i] = kind
    got = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {k: [k in got[i] for i in got if want[i] == k] for k in ("account", "local_phone", "ssn")}
    assert all(sum(v) / len(v) > 0.95 for v in hit.values()), {k: sum(v) / len(v) for k, v in hit.items()}
    assert all("number" not in got[i] and "account" not in got[i] for i in got if want[i].startswith("decoy"))
