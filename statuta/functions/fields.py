"""Fields derived from one sentence or obligation, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.functions import lexicon as L
from statuta.functions.columns import any_of, choose, cut, first_capital, folded, let, literals, squeeze, strip, words

I = "(?iU)"  # noqa: E741  case and Unicode as the patterns mean them


def found(s: Column, name: str, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern matches; it is tried only on texts that hold one of its stems. ``low`` is the ``folded`` text, if it is at hand."""
    held = let(folded(s), lambda x: any_of(x, L.STEMS[name])) if low is None else any_of(low, L.STEMS[name])
    return held & s.rlike(pattern)


def extract(s: Column, name: str, pattern: str, low: Column | None = None) -> Column:
    """The first group of a pattern's first match, '' where there is none, as ``found``."""
    held = let(folded(s), lambda x: any_of(x, L.STEMS[name])) if low is None else any_of(low, L.STEMS[name])
    return F.when(s.isNull() | held, F.regexp_extract(s, pattern, 1)).otherwise("")


def deadline(s: Column, low: Column | None = None) -> Column:
    """struct<deadline, deadline_type>: a relative term, else a fixed date, else a frequency, else none."""
    number, unit = F.regexp_extract(s, I + L.RELATIVE, 1), F.regexp_extract(s, I + L.RELATIVE, 2)
    pair = lambda d, t: F.struct(d.alias("deadline"), F.lit(t).alias("deadline_type"))
    return (
        F.when(found(s, "relative", I + L.RELATIVE, low), pair(F.lower(F.concat(F.lit("within "), number, F.lit(" "), unit)), "relative"))
        .when(s.rlike(r"(?U)\d{4}") & s.rlike(I + L.FIXED_DATE), pair(strip(F.regexp_extract(s, I + L.FIXED_DATE, 1)), "fixed"))
        .when(found(s, "frequency", I + L.FREQUENCY, low), pair(F.lower(F.regexp_extract(s, I + L.FREQUENCY, 1)), "recurring"))
        .otherwise(pair(F.lit(None).cast("string"), "not_specified"))
    )


def responsible(s: Column, fallback: str = "Compliance Officer", low: Column | None = None) -> Column:
    def of_role(role: Column) -> Column:
        named = F.when(F.lower(role) == "the board", F.lit("Board of Directors")).when(role == F.lower(role), F.initcap(role)).otherwise(role)
        return F.when(role != "", named).otherwise(let(extract(s, "entities", I + L.ENTITIES, low), of_entity))

    def of_entity(entity: Column) -> Column:
        return F.when(entity != "", F.concat(F.initcap(entity), F.lit(f" — {fallback}"))).otherwise(F.lit(fallback))

    return let(extract(s, "roles", I + L.ROLES, low), of_role)


def action(s: Column, low: Column | None = None) -> Column:
    duty = squeeze(F.regexp_extract(s, I + L.ACTION, 1))
    tidy = F.regexp_replace(F.regexp_replace(duty, r"(?U)\s*\b(and|or)\s*$", ""), r"^[ ,;]+|[ ,;]+$", "")
    return F.when(found(s, "action", I + L.ACTION, low), first_capital(tidy)).otherwise(strip(F.substring(s, 1, 160)))


def title(act: Column, s: Column, most: int = 11) -> Column:
    def short(w: Column) -> Column:
        return first_capital(F.concat(F.array_join(F.slice(w, 1, most), " "), F.when(F.size(w) > most, "…").otherwise("")))

    return let(words(F.coalesce(F.nullif(act, F.lit("")), s)), short)


def named_types(s: Column, table: Sequence[tuple[str, str]] = L.ENTITY_TYPES) -> Column:
    low = F.lower(s)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike("(?U)" + p), F.lit(t)) for p, t in table]))))


def evidence(s: Column, rules: Sequence = L.EVIDENCE_RULES, default: Sequence[str] = L.DEFAULT_EVIDENCE, most: int = 4) -> Column:
    """Artefacts of the rules that fire, distinct, in order, at most ``most``; the default where none fires."""
    low, none = F.lower(s), F.array().cast("array<string>")
    named = F.slice(F.array_distinct(F.concat(*[F.when(low.rlike("(?U)" + p), literals(a)).otherwise(none) for p, a in rules])), 1, most)
    return let(named, lambda a: F.when(F.size(a) > 0, a).otherwise(literals(default)))


def keywords(s: Column, stops: Sequence[str] = L.KEYWORD_STOPS, most: int = 6) -> Column:
    stop = literals(stops)
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(s), F.lit("[a-zA-Z][a-zA-Z-]{3,}"), F.lit(0)), lambda w: ~F.array_contains(stop, w))), 1, most)


def mandatory_terms(s: Column, terms: Sequence[str] = L.MANDATORY_TERMS, most: int = 4) -> Column:
    low = F.lower(s)
    return F.slice(F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t.strip())) for t in terms])), 1, most)


def severity(s: Column, deadline_type: Column, model: Column | None = None, confidence: Column | None = None, low: Column | None = None) -> Column:
    """struct<severity, basis>: high rules, low rules without a hard deadline, a hard deadline, the model where it
    is sure, else medium."""
    hits = lambda rules: F.array_compact(F.array(*[F.when(found(s, n, I + p, low), F.lit(n)) for n, p in rules.items()]))
    pair = lambda v, b: F.struct(v.alias("severity"), b.alias("basis"))
    rule = lambda a: F.concat(F.lit("rule: "), F.array_join(F.slice(a, 1, 2), ", "))
    hard = F.coalesce(deadline_type.isin("relative", "fixed"), F.lit(False))
    model = F.lit(None).cast("string") if model is None else model
    confidence = F.lit(0.0) if confidence is None else F.coalesce(confidence, F.lit(0.0))

    def decide(h: Column) -> Column:
        def with_low(minor: Column) -> Column:
            return (
                F.when(F.size(h) > 0, pair(F.lit("high"), rule(h)))
                .when((F.size(minor) > 0) & ~hard, pair(F.lit("low"), rule(minor)))
                .when(hard, pair(F.lit("medium"), F.lit("rule: hard deadline, no escalating factor")))
                .when(model.isNotNull() & (model != "") & (confidence >= 0.60), pair(model, F.format_string("model (%.2f)", confidence)))
                .otherwise(pair(F.lit("medium"), F.lit("default (no decisive signal)")))
            )

        return let(hits(L.LOW_SEVERITY), with_low)

    return let(hits(L.HIGH_SEVERITY), decide)


def days_until(d: Column, as_of: Column) -> Column:
    """Days to a written date in the first of the known formats that parses; null for anything else."""
    parsed = F.coalesce(*[F.try_to_date(strip(d), f) for f in L.DATE_FORMATS])
    return F.date_diff(parsed, as_of)


def days_remaining(d: Column, kind: Column, as_of: Column) -> Column:
    """Days left by a deadline text: an ISO date, a number of days, a frequency, or 30 for other recurring ones."""
    iso = F.regexp_extract(d, r"(\d{4}-\d{2}-\d{2})", 1)
    within = F.regexp_extract(d, r"(?iU)within\s+(\d+)\s+(?:working\s+)?days?", 1)
    number = F.regexp_extract(d, r"(?iU)(\d+)\s+(?:working\s+)?days?", 1)
    date = F.try_to_date(F.nullif(iso, F.lit("")), "yyyy-MM-dd")
    return (
        F.when(F.coalesce(d, F.lit("")) == "", F.lit(None).cast("int"))
        .when(date.isNotNull(), F.date_diff(date, as_of))
        .when(within != "", within.try_cast("int"))
        .when(number != "", number.try_cast("int"))
        .when(d.rlike("(?i)monthly|every month"), 30)
        .when(d.rlike("(?i)quarterly"), 90)
        .when(d.rlike("(?i)annual|yearly"), 365)
        .when(kind == "recurring", 30)
    )


def risk_score(sev: Column, ev: Column, days: Column, dependents: Column) -> Column:
    """0 to 100: severity, evidence, urgency and dependents; unknown severity counts 20, unknown evidence 30."""
    urgency = F.when(days.isNull(), 0).when(days < 0, 20).when(days <= 7, 15).when(days <= 30, 10).when(days <= 90, 5).otherwise(0)
    return F.least(choose(sev, L.SEVERITY_POINTS, 20) + choose(ev, L.EVIDENCE_POINTS, 30) + urgency + F.least(2 * F.coalesce(dependents, F.lit(0)), F.lit(10)), F.lit(100)).cast("double")


def risk_label(score: Column) -> Column:
    return F.when(score <= 30, "Low").when(score <= 65, "Medium").otherwise("High")


def department(party: Column, table: Sequence[tuple[str, str]] = L.DEPARTMENTS) -> Column:
    low, out = F.lower(party), F.lit("Compliance")
    for word, name in reversed(table):
        out = F.when(low.contains(word), F.lit(name)).otherwise(out)
    return out


def priority(sev: Column, kind: Column, days: Column) -> Column:
    base = choose(F.concat_ws("|", sev, F.coalesce(F.nullif(kind, F.lit("")), F.lit("not_specified"))), {"|".join(k): v for k, v in L.PRIORITIES.items()}, "medium")
    return F.when(days < 0, "critical").when((days <= 7) & base.isin("medium", "low"), "high").otherwise(base)


def filled(template: str, values: dict[str, Column]) -> Column:
    """A text with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if i % 2 or x])


def _step_values(form: int, clause: Column, act: Column, ev: Column, party: Column, due: Column) -> dict[str, Column]:
    given = {"action": act, "evidence": F.array_join(F.slice(ev, 1, 3), ", "), "party": party, "due": due}
    default = {k: v if isinstance(v, str) else v[form] for k, v in L.STEP_DEFAULTS.items()}
    return {"clause": F.coalesce(clause, F.lit(default["clause"]))} | {k: F.coalesce(F.nullif(c, F.lit("")), F.lit(default[k])) for k, c in given.items()}


def default_steps(clause: Column, act: Column, ev: Column, party: Column) -> Column:
    """The five-step procedure."""
    values = _step_values(0, clause, act, ev, party, F.lit(None).cast("string"))
    return F.array(*[filled(t, values) for t in L.DEFAULT_STEPS])


def template_steps(clause: Column, act: Column, ev: Column, party: Column, due: Column) -> Column:
    """The six-step procedure."""
    values = _step_values(1, clause, act, ev, party, due)
    return F.array(*[filled(t, values) for t in L.TEMPLATE_STEPS])


def effort(description: Column, ladder: dict[str, str]) -> Column:
    low = F.lower(description)
    return F.when(low.rlike(ladder["high"]), "high").when(low.rlike(ladder["medium"]), "medium").otherwise("low")


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.9, "0.9–1.0").when(c >= 0.8, "0.8–0.9").when(c >= 0.7, "0.7–0.8").when(c >= 0.6, "0.6–0.7").otherwise("0.55–0.6")


def clause_reference(number: Column, section: Column, document: Column, s: Column) -> Column:
    where = F.when(number != "", F.concat(F.lit("Clause "), number)).otherwise(document)
    return F.concat(where, F.lit(" — "), section, F.lit(': "'), F.substring(s, 1, 180), F.lit('"'))


def applies_to(text_types: Column, model_types: Column, requested: Column) -> Column:
    """Types named in the text, else the model's, else those asked for, else stockbroker; within those asked for."""
    filled = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    found = F.when(filled(text_types), text_types).when(filled(model_types), model_types).when(filled(requested), requested).otherwise(F.array(F.lit("stockbroker")))
    both = F.array_sort(F.array_intersect(found, requested))
    return F.when(~filled(requested), found).when(F.size(both) > 0, both).otherwise(requested)


def checklist(ev: Column) -> Column:
    return F.transform(ev, lambda x, i: F.struct(F.concat(F.lit("chk_"), i.cast("string")).alias("item_id"), x.alias("label"), F.lit(False).alias("completed")))


def adopt_type(found: Column, kind: Column, model_kind: Column) -> Column:
    """The deadline type: the surface one where a deadline was found, else a known type of the model."""
    return F.when(found.isNull() & model_kind.isin("recurring", "relative", "fixed"), model_kind).otherwise(kind)


def trigger_confidence(description: Column, act: Column, section: Column, triggers: Sequence[str] = L.RESPONSE_TRIGGERS) -> Column:
    """struct<triggers, confidence, rationale> of a row that comes from a response."""
    text = F.concat_ws("\n", F.lower(description), F.lower(act))
    hits = F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in triggers]))

    def build(h: Column) -> Column:
        why = F.when(F.size(h) > 0, F.concat(F.lit(L.EXTRACTED_FROM[2]), F.array_join(F.slice(h, 1, 3), ", "), F.lit(L.EXTRACTED_FROM[3]))).otherwise(L.EXTRACTED_FROM[4])
        return F.struct(h.alias("triggers"), F.when(F.size(h) > 0, 0.95).otherwise(0.70).alias("confidence"), F.concat(F.lit(L.EXTRACTED_FROM[0]), section, F.lit(L.EXTRACTED_FROM[1]), why).alias("rationale"))

    return let(hits, build)


def token_overlap(a: Column, b: Column, pattern: str = "[a-z]{4,}") -> Column:
    """Shared words over the words of the smaller set; 0 where either has none."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)))
    return let(tokens(a), lambda x: let(tokens(b), lambda y: F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))))


def evidence_score(document: Column, requirement: Column) -> Column:
    """Share of a requirement's words that the document holds as substrings."""
    low = F.lower(document)
    return let(words(F.lower(requirement)), lambda w: F.size(F.filter(w, lambda x: low.contains(x))) / F.greatest(F.size(w), F.lit(1)))


def evidence_status(score: Column) -> Column:
    return F.when(score >= 0.8, "green").when(score >= 0.4, "yellow").otherwise("red")


def severity_rank(c: Column) -> Column:
    return choose(c, {"low": 0, "medium": 1, "high": 2}, 0)


def slug(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, most)


def url_hash(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 8)


def excerpt(c: Column, n: int) -> Column:
    return cut(c, n, "…")


def modality_features(s: Column, low: Column | None = None) -> dict[str, Column]:
    """The twenty features of a sentence, each a double."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    size = lambda p: F.length(s) - F.length(F.regexp_replace(s, p, ""))
    n, chars, alpha = F.greatest(F.size(words(s)), F.lit(1)), F.greatest(F.length(s), F.lit(1)), size(r"\p{L}")
    out = {k: flag(found(s, k, p, low) if k in L.STEMS else s.rlike(p)) for k, p in L.FEATURES.items()}
    out |= {
        "len_words_norm": F.least(n / 60.0, F.lit(1.0)),
        "digit_ratio": size(r"\p{Nd}") / chars,
        "caps_ratio": F.when(alpha > 0, size(r"\p{Lu}") / F.greatest(alpha, F.lit(1))).otherwise(0.0),
        "punct_ratio": size(r"(?U)[^\p{L}\p{N}\s]") / chars,
        "dot_leader": flag(s.rlike(L.DOT_LEADER)),
        "trailing_page_number": flag(strip(s).rlike(L.TRAILING_PAGE)),
        "reference_only": flag(strip(s).rlike(L.ONLY_REFERENCE)),
        "is_definition": flag(s.rlike(L.DEFINITION)),
        "starts_with_clause_number": flag(s.rlike(r"(?U)^\s*\d+(\.\d+)*\s")),
        "ends_with_period": flag(F.endswith(strip(s), F.lit("."))),
        "comma_density": F.least((F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))) / n * 5, F.lit(1.0)),
        "annexure_index_run": flag(F.regexp_count(s, F.lit(L.ANNEX_REFERENCE)) >= 2),
        "starts_with_annexure": flag(s.rlike(L.ANNEX_BEGINNING)),
    }
    return out
