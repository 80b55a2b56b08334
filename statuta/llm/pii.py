"""Personal data by weak supervision, in DataFrame functions only.

Base spans are those of four validated patterns. Further candidates (local phones, social security numbers, account
numbers, and long numbers that fail the card check) are judged by three labelers, each of which votes yes, no or
abstains: the arithmetic of the kind (check sums and number plans), a gazetteer (lists of country codes, issuers,
domains), and the words before the span, for or against. Base spans are labelled as well and count as
true, which anchors the estimate. Expectation-maximisation over the table of vote patterns (of bounded
size, whatever the corpus, so it runs on the driver) estimates each labeler's rates and each kind's share of true spans; with
the posteriors as soft labels a logistic classifier over kind, votes, length and shape is trained and decides on
each candidate. Base spans always stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import let, materialize, regex_spans

# The base patterns.
# Possessive repeats and look-behinds match what the plain patterns match, in linear time: a match can begin
# only where a run of its first characters begins, or where the match before has ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+().-])(?<![0-9+().-]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "ssn", "account", "number")

NO, YES, ABSTAIN = 0, 1, 2
#: Words before a span that speak for its kind, and those that speak against any kind; a parameter of ``scan``.
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reach|courriel|correo)[^0-9@]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login)[^0-9]{0,24}$",
    "card": r"(?i)(?:card|visa|credit|debit|carte|tarjeta|karte|cvv)[^0-9]{0,24}$",
    "phone": r"(?i)(?:phone|call|\btel\b|mobile|cell|fax|contact)[^0-9]{0,24}$",
    "local_phone": r"(?i)(?:phone|call|\btel\b|mobile|cell|fax|contact)[^0-9]{0,24}$",
    "ssn": r"(?i)(?:\bssn\b|social|security|taxpayer)[^0-9]{0,24}$",
    "account": r"(?i)(?:iban|account|bank|konto|compte|cuenta)[^0-9]{0,24}$",
    "number": r"(?i)(?:card|visa|credit|debit|carte|tarjeta|karte|cvv)[^0-9]{0,24}$",
    "against": r"(?i)(?:isbn|order|invoice|serial|version|\bref|ticket|tracking|part|model|page|figure|\bno\.)[^0-9]{0,12}$",
}
#: Entries that are known for a kind; a parameter of ``scan``. Public numbering plans.
GAZETTEER = {
    # top-level domains
    "email": "com org net edu gov info biz io co eu uk de fr es it nl be ch at pl pt se dk no fi ie us ca au jp cn in br mx".split(),
    # first octets that no public host has: own and local networks, loopback, multicast, reserved
    "ip": [*"0 10 127".split(), *map(str, range(224, 256))],
    # beginnings of card numbers by issuer
    "card": "4 51 52 53 54 55 34 37 35 36 38 6011 65 62 222 223 224 225 226 227 23 24 25 26 270 271 2720".split(),
    # country calling codes
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 234 254 255 256 351 352 353 354 355 356 357 358 359 370 371 372 380 385 386 420 421 852 886 961 962 965 966 971 972 974".split(),
    # area codes that are dialled free of charge: no person's number
    "local_phone": "800 833 844 855 866 877 888 900".split(),
    # numbers printed in advertisements
    "ssn": "078-05-1120 219-09-9999 457-55-5462".split(),
    # lengths of account numbers by country
    "account": "AT20 BE16 CH21 DE22 DK18 ES24 FI18 FR27 GB22 IE22 IT27 LU20 NL18 NO15 PL28 PT25 SE24".split(),
}
GAZETTEER["number"] = GAZETTEER["card"]


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(d, n - i + 1, F.lit(1)).cast("int"), lambda x: F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":  # leading zeros do not change a part's value
        return ~match.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def mod97(account: Column) -> Column:
    """The remainder by 97 of an account number with its first four characters put last, letters as 10 to 35."""
    signs = F.split(F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """A vote from what speaks for it and, where that is something else than its contrary, what speaks against it."""
    no = ~yes if no is None else no
    return F.when(F.coalesce(yes, F.lit(False)), YES).when(F.coalesce(no, F.lit(False)), NO).otherwise(ABSTAIN)


def votes(kind: str, s: Column, text: Column, context: dict[str, str], gazetteer: dict[str, list[str]]) -> list[Column]:
    """The votes of arithmetic, gazetteer and context on a span (struct of start, end, match)."""
    m, d = s["match"], digits(s["match"])
    listed = lambda c: c.isin(gazetteer[kind])
    begins = lambda c: F.lit(False) if not gazetteer[kind] else c.rlike("^(?:" + "|".join(gazetteer[kind]) + ")")
    area, exchange = F.substring(d, 1, 3), F.substring(d, 4, 3)
    plan = area.rlike("^[2-9][0-8][0-9]") & ~area.rlike("11$") & exchange.rlike("^[2-9]") & ~exchange.rlike("11$")
    arithmetic = {
        "email": lambda: _vote(m.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$")),
        "ip": lambda: _vote(~m.rlike(r"(?:^|\.)0[0-9]|^[0-9](?:\.[0-9]){3}$"), m.rlike(r"(?:^|\.)0[0-9]")),  # single digits may be a version
        "card": lambda: _vote(luhn(d)),
        "number": lambda: _vote(luhn(d)),
        "phone": lambda: _vote((F.length(F.translate(m, ")", "")) == F.length(F.translate(m, "(", ""))) & ~m.rlike(r"[.-]{2}|\x20{2}")),
        "local_phone": lambda: _vote(plan),
        "ssn": lambda: _vote(~m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "account": lambda: _vote(mod97(m) == 1),
    }[kind]()
    known = {
        "email": lambda: _vote(listed(F.lower(F.substring_index(m, ".", -1))), F.lit(False)),
        "ip": lambda: _vote(~listed(F.substring_index(m, ".", 1))),
        "card": lambda: _vote(begins(d)),
        "number": lambda: _vote(begins(d)),
        "phone": lambda: _vote(begins(d)),
        "local_phone": lambda: _vote(F.lit(False), listed(area)),
        "ssn": lambda: _vote(F.lit(False), listed(m)),
        "account": lambda: _vote(listed(F.concat(F.substring(m, 1, 2), F.length(m).cast("string")))),
    }[kind]()
    before = F.substring(text, F.greatest(s["start"] - 39, F.lit(1)).cast("int"), F.least(s["start"], F.lit(40)).cast("int"))
    return [arithmetic, known, _vote(before.rlike(context[kind]), before.rlike(context["against"]))]


def _pattern(kind: str, s: Column, text: Column, context: dict[str, str], gazetteer: dict[str, list[str]]) -> Column:
    """kind, the three votes, and two coarse features of a span, as one string."""
    shape = F.when(s["match"].rlike(r"[\x20.()-]"), "s").otherwise("p")
    return F.concat_ws("|", F.lit(kind), *[v.cast("string") for v in votes(kind, s, text, context, gazetteer)], F.least(F.length(digits(s["match"])), F.lit(24)).cast("string"), shape)


def candidates(docs: DataFrame, context: dict[str, str], gazetteer: dict[str, list[str]]) -> DataFrame:
    """doc_id, base spans, further candidates and the patterns of the base spans of each row (arrays), written once."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some_digit = t.rlike("[0-9]")
    patterns = {"email": (EMAIL, t.contains("@")), "ip": (IP, t.rlike(r"[0-9]\.[0-9]")), "card": (CARD, some_digit), "phone": (PHONE, t.contains("+"))}
    cols = {k: regex_spans(t, p, guard=g) for k, (p, g) in patterns.items()}
    judged = lambda k, a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _pattern(k, s, t, context, gazetteer).alias("pattern")))
    passing = lambda k: F.filter(cols[k], lambda s: valid(k, s["match"]))
    long_number = lambda s: F.length(digits(s["match"])).between(13, 19)
    cards = let(
        cols["card"],
        lambda a: F.struct(
            judged("card", F.filter(a, lambda s: valid("card", s["match"]))).alias("base"),
            judged("number", F.filter(a, lambda s: long_number(s) & ~valid("card", s["match"]))).alias("more"),
        ),
    )
    more = {"local_phone": LOCAL_PHONE, "ssn": SSN, "account": ACCOUNT}
    found = docs.select(
        "doc_id",
        *[judged(k, passing(k)).alias(k) for k in ("email", "ip", "phone")],
        cards.alias("cards"),
        F.concat(*[judged(k, regex_spans(t, p, guard=some_digit)) for k, p in more.items()]).alias("others"),
    )
    found = found.select("doc_id", "email", "ip", F.col("cards.base").alias("card"), "phone", F.concat("others", "cards.more").alias("more"))
    strip = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    return materialize(found.select("doc_id", *[strip(k) for k in BASE], "more", F.concat(*[F.col(f"{k}.pattern") for k in BASE]).alias("base_patterns")), "personal")


#: What a labeler that does not abstain is taken to do at first: how often it votes no and yes on false and on true spans.
FIRST_RATES = ((0.7, 0.3), (0.2, 0.8))


def estimate(rows: list[tuple], rounds: int = 200) -> tuple[dict[str, float], list, list[float]]:
    """Expectation-maximisation over vote patterns, rows of (kind, votes, count, known to be true).

    Gives each kind's share of true spans, each labeler's rates [false or true][no or yes] where it votes, and each
    row's posterior. Whether a labeler abstains says nothing, since that depends on the kind and the place. The
    shares and rates are means with a pseudo-count of one, so no kind or vote is ever impossible.
    """
    if not rows:
        return {}, [], []
    n = np.asarray([r[2] for r in rows], float)
    cast = np.asarray([r[1] for r in rows], int).reshape(len(rows), -1)
    kinds = sorted({r[0] for r in rows})
    kind = np.asarray([kinds.index(r[0]) for r in rows], int)
    known = np.asarray([bool(r[3]) for r in rows])
    share = np.full(len(kinds), 0.5)
    rates = np.tile(np.asarray(FIRST_RATES), (cast.shape[1], 1, 1))

    def posterior() -> np.ndarray:
        yes, no = share[kind].copy(), 1 - share[kind]
        for i in range(cast.shape[1]):
            voted = cast[:, i] != ABSTAIN
            yes[voted] *= rates[i, 1, cast[voted, i]]
            no[voted] *= rates[i, 0, cast[voted, i]]
        return np.where(known, 1.0, yes / np.maximum(yes + no, 1e-300))

    for _ in range(rounds):
        p = posterior()
        new = (np.bincount(kind, n * p, len(kinds)) + 0.5) / (np.bincount(kind, n, len(kinds)) + 1)
        for i in range(cast.shape[1]):
            voted = cast[:, i] != ABSTAIN
            for true, w in ((0, n * (1 - p)), (1, n * p)):
                rates[i, true] = (np.bincount(cast[voted, i], w[voted], 2) + np.asarray(FIRST_RATES[true])) / (w[voted].sum() + 1)
        done = np.abs(new - share).max() < 1e-9
        share = new
        if done:
            break
    return dict(zip(kinds, share.tolist())), rates.tolist(), posterior().tolist()


def reliabilities(patterns: DataFrame, rounds: int = 25) -> tuple[float, list[tuple[float, float]]]:
    """The share of true spans and, for each of three labelers, how often it votes yes on true and on false ones, from
    a small table of vote patterns (v1, v2, v3, n).
    """
    share, rates, _ = estimate([("", (r["v1"], r["v2"], r["v3"]), r["n"], False) for r in patterns.collect()], rounds)
    return share.get("", 0.5), [(r[1][YES], r[0][YES]) for r in rates]


def features_of(pattern: str) -> list[str]:
    """What the classifier knows of a span: its kind, each vote that was cast, its number of digits and its shape within the kind."""
    kind, *cast, length, shape = pattern.split("|")
    return [f"kind {kind}", *[f"vote {i} {v}" for i, v in enumerate(cast) if int(v) != ABSTAIN], f"length {kind} {length}", f"shape {kind} {shape}"]


def train(table: dict[str, tuple[float, float]], ridge: float = 1.0, rounds: int = 30) -> dict[str, float]:
    """A logistic classifier on soft labels by Newton steps: the weight of each feature, from pattern -> (count, share true)."""
    names = sorted({f for p in table for f in features_of(p)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(table), len(names)))
    for row, p in zip(x, table):
        row[[place[f] for f in features_of(p)]] = 1
    n, y = (np.asarray([t[k] for t in table.values()], float) for k in (0, 1))
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(names)), x.T @ (n * (y - p)) - ridge * w) if len(names) else w
        w = w + step
        if not len(step) or np.abs(step).max() < 1e-9:
            break
    return dict(zip(names, w.tolist()))


def accepted_patterns(found: DataFrame, threshold: float = 0.5) -> tuple[list[str], tuple]:
    """The candidate patterns that the classifier accepts; there are at most some thousand patterns, whatever the corpus."""
    told = found.select(F.explode(F.concat(F.transform("more", lambda s: F.concat(F.lit("?"), s["pattern"])), F.transform("base_patterns", lambda p: F.concat(F.lit("!"), p)))).alias("pattern"))
    counts = sorted((r["pattern"], r["n"]) for r in told.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    rows = [(p[1:].split("|")[0], tuple(map(int, p.split("|")[1:4])), n, p[0] == "!") for p, n in counts]
    share, rates, true = estimate(rows)
    weights = train({p[1:]: (n, t) for (p, n), t in zip(counts, true)})
    odds = {p[1:]: sum(weights[f] for f in features_of(p[1:])) for p, _ in counts if p[0] == "?"}
    return sorted(p for p, s in odds.items() if 1 / (1 + np.exp(-s)) >= threshold), (share, rates, weights)


def scan(docs: DataFrame, threshold: float = 0.5, context: dict[str, str] | None = None, gazetteer: dict[str, list[str]] | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, kinds as listed).

    A null or empty text has no spans; null ids pass; repeated rows give the same result each; places count code points of
    the whole text, however long; columns other than doc_id and text are not read and may have any name; an empty table gives no
    rows. No row is dropped.
    """
    found = candidates(docs, context or CONTEXT, gazetteer or GAZETTEER)
    accepted, _ = accepted_patterns(found, threshold)
    listed = F.array(*[F.lit(p) for p in accepted]).cast("array<string>")
    more = F.filter("more", lambda s: F.array_contains(listed, s["pattern"]))
    ranked = lambda k, a: F.transform(a, lambda s: F.struct(F.lit(KINDS.index(k)).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    names = F.array(*[F.lit(k) for k in KINDS])
    rank_of = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    added = F.transform(more, lambda s: F.struct(F.element_at(rank_of, F.substring_index(s["pattern"], "|", 1)).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    render = lambda a: F.array_join(F.transform(F.sort_array(a), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")
    base = F.concat(*[ranked(k, F.col(k)) for k in BASE])
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(render(base), 256).alias("base_sha256"),
        render(F.concat(base, added)).alias("spans"),
    )
