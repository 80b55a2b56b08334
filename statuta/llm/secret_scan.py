"""Secret scanning with multipart credential linking, in DataFrame functions only.

Base spans are those of three patterns. The method adds weak candidates: short assigned values, bare
40-character keys and endpoints, none of which says much alone. They are joined with the complementary parts
of the same text that leave at most ``scope`` characters between them (an interval join on bins of that size), and are
reported only where such a part is found: a weak secret needs an access identifier or an endpoint, an
endpoint needs an access identifier or a secret. Assigned values, hex runs and weak secrets are secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import let, materialize, regex_spans

# The base patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "weak_secret", "endpoint")
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|mongodb|postgres(?:ql)?|mysql|redis|amqps?)://[A-Za-z0-9._~%:@/?#&=+-]{4,}+"
BARE_KEY = r"(?<![A-Za-z0-9/+=_.-])(?![0-9a-f]{40})[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=_.-])"


def _kind(spans: Column, rank: int) -> Column:
    """Spans without their text, as struct<start,rank,end>, which sorts by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end")))


def _render(spans: Column) -> Column:
    """Spans as kind:start:end, by start and then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def candidates(docs: DataFrame, least_assign: int = 12, least_weak: int = 6, whole_rows: bool = False) -> DataFrame:
    """Base and weak spans of each row (arrays), with a tag of the row and its doc_id, or its whole as a struct ``row``;
    written once, so that texts are read only once.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a pattern is tried only on texts that hold a word it needs
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1))
    assigned = regex_spans(t, ASSIGN, guard=t.rlike("(?i:passw|secret|token|api_?key)"))
    access = regex_spans(t, ACCESS, guard=t.contains("AKIA"))
    hexes = regex_spans(t, HEX)
    endpoints = regex_spans(t, ENDPOINT, guard=t.contains("://"))
    # bare keys matter only beside an access identifier or an endpoint
    bare = regex_spans(t, BARE_KEY, guard=t.contains("AKIA") | t.contains("://"))
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if whole_rows else F.col("doc_id")
    found = docs.select(
        F.monotonically_increasing_id().alias("tag"),
        kept,
        let(
            assigned,
            lambda a: F.struct(
                _kind(F.filter(a, lambda s: value(s) >= least_assign), 0).alias("strong"),
                _kind(F.filter(a, lambda s: (value(s) < least_assign) & (value(s) >= least_weak)), 3).alias("weak"),
            ),
        ).alias("a"),
        _kind(F.filter(access, lambda s: s["end"] - s["start"] >= 18), 1).alias("access"),
        _kind(hexes, 2).alias("hex"),
        _kind(endpoints, 4).alias("endpoint"),
        _kind(bare, 3).alias("bare"),
    )
    return materialize(found.select("tag", "row" if whole_rows else "doc_id", F.col("a.strong").alias("assign"), "access", "hex", F.concat("a.weak", "bare").alias("weak"), "endpoint"), "candidates")


def needs_linking() -> Column:
    """Whether a row holds a weak part and any other part that might complete it."""
    weak = F.size("weak") + F.size("endpoint")
    return (weak > 0) & (F.size("assign") + F.size("access") + F.size("hex") + weak > 1)


def link(both: DataFrame, scope: int = 400) -> DataFrame:
    """Weak and endpoint spans that have a complementary part with at most ``scope`` characters between the two: tag and spans.

    A part goes to every bin that its interval, widened by the scope, crosses, and a candidate to every bin that it
    crosses itself. Spans of a kind do not overlap, so the bin's size bounds what meets there, and a span takes as many bins as its
    length fills.
    """
    role_of = lambda c, r: F.transform(c, lambda s: F.struct(s["start"].alias("first"), s["end"].alias("last"), F.lit(r).alias("role")))
    # role 1: identifiers, 2: secrets, 3: endpoints
    roles = (("access", 1), ("assign", 2), ("hex", 2), ("weak", 2), ("endpoint", 3))
    parts = both.select("tag", F.inline(F.concat(*[role_of(c, r) for c, r in roles])))
    width = scope + 1
    bins = lambda first, last: F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    near = parts.select("tag", "first", "last", "role", bins(F.col("first") - scope, F.col("last") + scope).alias("bin"))
    weak = both.select("tag", F.explode(F.concat("weak", "endpoint")).alias("span"))
    weak = weak.select("tag", "span", bins(F.col("span.start"), F.col("span.end")).alias("bin"))
    # a secret needs an identifier or an endpoint, an endpoint an identifier or a secret: any other role will do
    role = F.when(F.col("span.rank") == 3, 2).otherwise(3)
    w, n = weak.withColumn("own", role).alias("w"), near.alias("n")
    gap = F.greatest(F.col("w.span.start") - F.col("n.last"), F.col("n.first") - F.col("w.span.end"))
    linked = w.join(n, (F.col("w.tag") == F.col("n.tag")) & (F.col("w.bin") == F.col("n.bin")) & (gap <= scope) & (F.col("w.own") != F.col("n.role")), "left_semi")
    return linked.groupBy("tag").agg(F.collect_set("span").alias("linked"))


def with_links(found: DataFrame, scope: int) -> DataFrame:
    """The candidates with their ``linked`` spans; only rows that need linking are joined, no other row moves."""
    none = F.array().cast("array<struct<start:long,rank:int,end:long>>")
    both = found.filter(needs_linking())
    joined = both.join(link(both, scope), "tag", "left").withColumn("linked", F.coalesce("linked", none))
    return found.filter(~needs_linking()).withColumn("linked", none).unionByName(joined)


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the spans themselves (array ``found``).

    A null or empty text has no spans; null ids pass; repeated rows give the same result each; places count code points of
    the whole text, however long; columns other than doc_id and text are not read and may have any name; an empty table gives no
    rows. No row is dropped.
    """
    base = F.concat("assign", "access", "hex")
    joined = with_links(candidates(docs), scope).withColumn("all", F.concat(base, "linked"))
    return joined.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_render(base), 256).alias("base_sha256"),
        _render(F.col("all")).alias("spans"),
        F.sort_array("all").alias("found"),
    )


def redact(docs: DataFrame, scope: int = 400, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with each reported secret replaced by ``mark``; no row goes.

    Endpoints stay, since they are no secrets. Rows without secrets, null and empty texts stay as they are; repeated rows
    are changed alike; n_chars, where there is such a column, follows a text that was changed. Columns may have any
    name, since a row travels whole in a struct beside its spans; only rows with weak parts to link are moved. An
    empty table stays empty.
    """
    found = with_links(candidates(docs, whole_rows=True), scope)
    spans = F.concat("assign", "access", "hex", "linked")
    found = found.select("row", F.sort_array(F.filter(spans, lambda s: s["rank"] != 4)).alias("cuts"))
    text, zero = F.col("row.text").cast("string"), F.lit(0).cast("long")
    body = F.aggregate(
        "cuts",
        F.struct(zero.alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    changed = F.size("cuts") > 0
    found = found.select("row", changed.alias("changed"), F.when(changed, body).otherwise(text).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    of = lambda c: F.col(f"row.`{c}`")
    return found.select(*[F.when(F.col("changed"), new[c].cast(docs.schema[c].dataType)).otherwise(of(c)).alias(c) if c in new else of(c).alias(c) for c in docs.columns])
