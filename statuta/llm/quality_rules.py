"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a Column that is true where a text fails it. Each rule's cost (seconds a row) and selectivity
(share of rows rejected) are estimated on a bounded sample; the cascade then tries rules in the order of
rejection per cost, and a text that fails a rule is not tried on the later ones. The verdict is the same in
any order, since a text is kept only where no rule fails.

The sample comes from the first partitions that hold enough rows, so its price does not follow the corpus. A rule is
timed as it will be tried: by how much further repetitions of the sample prolong one task, so that planning, compiling
and scheduling do not count. Costs are rounded to powers of two, so that the clock's noise seldom changes the order;
ties go by selectivity and name. ``text_costs`` replaces the clock where the order has to be the same in every run.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.llm.common import SPACE, let, materialize

Rules = dict[str, Callable[[Column], Column]]


def words(text: Column) -> Column:
    """The words of a text, none for a null or blank one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    """Characters out of ``#*$%&|<>``."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def n_repeat_words(w: Column, span: int = 3) -> Column:
    """Words of an array that lie in windows of ``span`` words found twice or more in it.

    The windows' 64-bit hashes are sorted with their places, so equal ones become neighbours; the places of repeated ones
    are then sorted and their covers added, each word once. All of it is n log n in one row's words. (Two
    different windows of a text of n words share a hash with a chance of less than n * n / 2**65.)
    """
    zero = F.lit(0).cast("long")

    def hashes(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - span), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(span)]))

    def repeated(h: Column) -> Column:
        def neighbours(s: Column) -> Column:
            same = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        return let(F.sort_array(F.transform(h, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), neighbours)

    def cover(p: Column) -> Column:
        seen = F.aggregate(
            p,
            F.struct(F.lit(-span).alias("last"), zero.alias("n")),
            lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(span), x - s["last"])).alias("n")),
        )
        return seen["n"]

    def count(a: Column) -> Column:
        # most texts repeat no window, which the number of distinct hashes tells without a sort
        found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(repeated(h), cover)).otherwise(zero)
        return F.when(F.size(a) > span, let(hashes(a), found)).otherwise(zero)

    return let(w, count)


def stats(text: Column) -> dict[str, Column]:
    """The measured columns of a text."""
    w = words(text)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": word_chars(text),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(w),
    }


def default_rules(
    min_words: int = 50,
    repeat_share: float = 0.5,
    symbol_share: float = 0.1,
    mean_word: tuple[float, float] = (2.0, 20.0),
    dup_line_share: float = 0.5,
) -> Rules:
    """Rules over the measured columns, each true where a text fails."""
    c = F.col
    return {
        "too_few_words": lambda t: c("n_words") < min_words,
        "repeated_words": lambda t: 100 * c("n_repeat_words") > int(100 * repeat_share) * c("n_words"),
        "symbols": lambda t: c("n_symbols") > symbol_share * c("word_chars"),
        "word_length": lambda t: (c("word_chars") < mean_word[0] * c("n_words")) | (c("word_chars") > mean_word[1] * c("n_words")),
        "repeated_lines": lambda t: c("n_dup_lines") > dup_line_share * (F.size(F.split(F.coalesce(t, F.lit("")), "\n"))),
    }


def text_rules(**limits) -> Rules:
    """The default rules as functions of the text alone: a rule that is not reached measures nothing."""
    min_words = limits.get("min_words", 50)
    repeat, symbol = limits.get("repeat_share", 0.5), limits.get("symbol_share", 0.1)
    low, high = limits.get("mean_word", (2.0, 20.0))
    dup = limits.get("dup_line_share", 0.5)
    return {
        "too_few_words": lambda t: F.size(words(t)) < min_words,
        "repeated_words": lambda t: let(words(t), lambda w: 100 * n_repeat_words(w) > int(100 * repeat) * F.size(w)),
        "symbols": lambda t: n_symbols(t) > symbol * word_chars(t),
        "word_length": lambda t: (word_chars(t) < low * F.size(words(t))) | (word_chars(t) > high * F.size(words(t))),
        "repeated_lines": lambda t: n_dup_lines(t) > dup * F.size(F.split(F.coalesce(t, F.lit("")), "\n")),
    }


def text_costs() -> Rules:
    """Nanoseconds that each of the default rules takes on a text, by the work it does (measured once, on one core)."""
    size = lambda t: F.length(F.coalesce(t, F.lit("")))
    return {
        "too_few_words": lambda t: 40 * size(t),
        "repeated_words": lambda t: 40 * size(t) + 700 * F.size(words(t)),
        "symbols": lambda t: 80 * size(t),
        "word_length": lambda t: 90 * size(t),
        "repeated_lines": lambda t: 15 * size(t),
    }


def sample_of(docs: DataFrame, text: str = "text", sample_rows: int = 2000, longest: int = 20_000) -> DataFrame:
    """Up to ``sample_rows`` texts of up to ``longest`` characters from the first partitions that have enough of them, written once.

    What comes to the driver is bounded and other partitions are not read. It only orders rules and never decides on a row.
    """
    value = F.col(f"`{text}`").cast("string").alias("text")
    texts = docs.select(value).filter(F.coalesce(F.length("text"), F.lit(0)) <= longest).limit(sample_rows).collect()
    return materialize(docs.sparkSession.createDataFrame([(r["text"],) for r in texts], "text string").coalesce(1), "rule-sample")


def order_on(sample: DataFrame, rules: Rules, costs: Rules | None = None, repeats: int = 6) -> list[dict]:
    """Each rule's cost (seconds a row) and selectivity on a written sample, best rejection per cost first.

    ``costs`` estimates a rule's nanoseconds on a text; rules that it lacks are timed. An empty sample keeps the given order.
    """

    def run(failed: Column, times: int) -> float:
        rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_time")).coalesce(1).agg(F.count_if(failed))
        rows.first()
        began = time.perf_counter()
        rows.first()
        return time.perf_counter() - began

    fails = {name: F.coalesce(rule(F.col("text")), F.lit(False)) for name, rule in rules.items()}
    work = {name: F.avg(cost(F.col("text"))) for name, cost in (costs or {}).items() if name in rules}
    told = sample.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n {k}") for k, c in fails.items()], *[c.alias(f"ns {k}") for k, c in work.items()]).first()
    n = told["n"]
    if not n:
        return [{"rule": name, "cost": 0.0, "selectivity": 0.0, "rank": 0.0} for name in rules]
    least = 0.05 / (repeats * n)  # the clock tells 50 ms from nothing
    found = []
    for name, failed in fails.items():
        cost = told[f"ns {name}"] * 1e-9 if name in work else 2.0 ** round(math.log2(max((run(failed, 1 + repeats) - run(failed, 1)) / (repeats * n), least)))
        selectivity = told[f"n {name}"] / n
        found.append({"rule": name, "cost": cost, "selectivity": selectivity, "rank": selectivity / max(cost, 1e-9)})
    return sorted(found, key=lambda r: (-r["rank"], -r["selectivity"], r["rule"]))


def order_by_rejection_per_cost(docs: DataFrame, rules: Rules, text: str = "text", costs: Rules | None = None, sample_rows: int = 2000, repeats: int = 6, longest: int = 20_000) -> list[dict]:
    """``order_on`` the first texts of ``docs`` (``sample_of``)."""
    return order_on(sample_of(docs, text, sample_rows, longest), rules, costs, repeats)


def cascade(text: Column, rules: Rules, order: list[str]) -> Column:
    """The name of the first rule that fails, null where none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(F.coalesce(rules[name](text), F.lit(False)), F.lit(name)).otherwise(out)
    return out


def evaluated_counts(docs: DataFrame, rules: Rules, order: list[str], text: str = "text") -> list[tuple[str, int, int]]:
    """(rule, texts that it was tried on, texts that it rejected) in the cascade's order, by one aggregate."""
    by = {r["rule"]: r["n"] for r in docs.groupBy(cascade(F.col(f"`{text}`"), rules, order).alias("rule")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left, out = sum(by.values()), []
    for name in order:
        out.append((name, left, by.get(name, 0)))
        left -= by.get(name, 0)
    return out


def filter_by_rules(docs: DataFrame, rules: Rules | None = None, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are.

    A null or blank text has no words and is rejected by the word count. Repeated rows are judged each
    on its own; other columns may have any name, nulls in them do not matter; an empty table stays empty.
    """
    rules = rules or text_rules()
    order = [r["rule"] for r in order_by_rejection_per_cost(docs, rules, text, None, sample_rows)]
    return docs.filter(cascade(F.col(f"`{text}`"), rules, order).isNull())


def later_rules(**limits) -> Rules:
    """The default rules besides those of the base verdict, over the measured columns and, for lines, the text."""
    rules = default_rules(**limits)
    return {k: rules[k] for k in ("symbols", "word_length", "repeated_lines")}


def measured(docs: DataFrame, base_repeat: int = 50, min_words: int = 50) -> DataFrame:
    """doc_id, text, the measured columns (the words are split once a row) and base_failed."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > base_repeat * F.col("n_words"))
    return base.select("doc_id", "text", *[v.alias(k) for k, v in stats(F.col("text")).items()]).withColumn("base_failed", failed)


def judge(docs: DataFrame, sample_rows: int = 2000, base_repeat: int = 50, min_words: int = 50, rules: Rules | None = None) -> DataFrame:
    """Measured columns and verdict for every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    The measured columns and the base verdict belong to the result and are made for every row. The cascade of ``rules``
    (default: ``later_rules``) stands behind the base verdict: a row that fails it is tried on none of them. Their order comes
    from what they cost and reject among sampled rows that pass the base verdict. A null or empty text has no words, so
    it fails; repeated rows are judged each on its own; columns other than doc_id and text may have any name; an empty
    table gives no rows; rows are never dropped.
    """
    rules = rules or later_rules()
    sample = sample_of(docs, "text", sample_rows).select(F.lit(None).cast("long").alias("doc_id"), "text")
    passed = materialize(measured(sample, base_repeat, min_words).filter(~F.col("base_failed")), "rule-sample-measured")
    order = [r["rule"] for r in order_on(passed, rules)]
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(F.col("text"), rules, order).isNull())
    return measured(docs, base_repeat, min_words).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.alias("kept"))
