"""Queries over trained heads, explanations and document recognition: lists of (name, query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statuta.functions import fields as X
from statuta.operators import classify as K
from statuta.operators import similarity as S
from statuta.operators import text as T
from statuta.operators import training as TR
from statuta.plans import views as V
from statuta.plans.text_queries import STOPS, tf_sql
from statuta.session import materialize, scratch_path

FEATURES = ("digit_ratio", "punct_ratio", "caps_ratio", "comma_density")
STEPS, RATE, RIDGE = 25, 2.0, 0.001


def _featured(spark, d):
    """Labelled documents with four of the dense features of the whole text and their side of the split by source."""
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels").filter("quality is not null"), "doc_id")
    f = X.modality_features(F.coalesce("text", F.lit("")))
    return TR.group_split(rows.select("doc_id", "source", F.col("quality").alias("label"), *[f[n].alias(n) for n in FEATURES]), "source")


def _scored(spark, d):
    rows = materialize(_featured(spark, d), "featured")
    head = TR.fit_dense(rows.filter("not held_out"), FEATURES, steps=STEPS, rate=RATE, ridge=RIDGE)
    return head, rows.withColumn("probability", head.probability()).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))


def logistic_scores(spark, d):
    return _scored(spark, d)[1].select("doc_id", "held_out", F.bround("probability", 4).alias("probability"), "predicted")


def head_coefficients(spark, d):
    head, _ = _scored(spark, d)
    return spark.createDataFrame([(n, w) for n, w in head.coefficients()], "feature string, weight double").select("feature", F.bround("weight", 6).alias("weight"))


def training_report(spark, d):
    out = TR.held_out_report(_scored(spark, d)[1])
    return out.select("train_rows", "test_rows", *[F.bround(c, 6).alias(c) for c in ("baseline", "accuracy", "macro_f1")])


def _role_terms(spark, d):
    """(id, role, term, tf) of turns: words and character trigrams under their marks; turns are dealt by id, so that terms are counted where they are."""
    mark = lambda a, p: F.transform(a, lambda t: F.concat(F.lit(p), t))
    terms = F.concat(mark(S.word_terms(F.col("text"), 1, STOPS), "word__"), mark(S.char_terms(F.col("text"), 3, 3), "char__"))
    turns = V.turns(spark, d).select(F.concat_ws(":", F.col("circular_id").cast("string"), F.col("id").cast("string")).alias("id"), F.coalesce("role", F.lit("")).alias("role"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number is given, as a few large parts would leave cores idle
    return turns.repartition(parts, "id").select("id", "role", F.explode(terms).alias("term")).groupBy("id", "role", "term").agg(F.count(F.lit(1)).alias("tf"))


def explain_terms(spark, d):
    """What speaks for and against a turn being the user's, by a table of log odds of its terms."""
    counts = materialize(_role_terms(spark, d), "role-terms")  # the odds and the values read them
    odds = F.log((1 + F.count_if(F.col("role") == "user")) / (1 + F.count_if(F.col("role") != "user")))
    table = counts.groupBy("term").agg(F.bround(odds, 6).alias("weight"))
    values = counts.select("id", "term", (1 + F.log("tf")).alias("value"))
    return K.explain_terms(values, table).select("id", "feature", "contribution", "direction", "rank")


FAMILY_WORDS = {"en": ("the", "of", "and"), "fr": ("les", "est", "une"), "de": ("der", "die", "und"), "es": ("que", "los", "del")}


def training_windows(spark, d):
    """Windows of documents in English as circulars of their source's family, of others as negatives."""
    docs = V.documents(spark, d).withColumn("family", F.col("source"))
    out = K.document_windows(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'").drop("family"))
    return out.select("circular_id", "window_no", F.md5("text").alias("digest"), "is_circular", "family")


def recognised_documents(spark, d):
    """Documents from their windows: mean share of marked words, likeliest language by marker words, novelty against kept centroids."""
    docs = V.documents(spark, d)
    windows = T.windows(docs)
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    share = lambda marks: F.size(F.filter("w", lambda x: x.isin(*marks))) / F.greatest(F.size("w"), F.lit(1))
    scores = F.create_map(*[x for lang, marks in FAMILY_WORDS.items() for x in (F.lit(lang), share(marks))])
    rows = windows.withColumn("w", words).select("circular_id", "window_no", share([m for marks in FAMILY_WORDS.values() for m in marks]).alias("circular_probability"), scores.alias("family_scores"))
    rows = materialize(rows, "windows")  # two sums read them: words are taken from the windows once
    texts = docs.select(F.col("circular_id").alias("id"), F.col("lang").alias("family"), F.col("document_text").alias("text"))
    vectors = S.family_texts(texts, stops=STOPS)
    kept = S.save_centroids(S.family_means(vectors, texts), scratch_path(spark, "centroids"))
    out = K.recognise(rows, S.family_novelty(vectors, kept), sure_at=0.1)
    return out.select("circular_id", "circular_confidence", "windows_analysed", "family", "family_confidence", "novelty", "is_novel_topic", "is_circular")


def _half(spark, folder, kind):
    """Half of a folder's files: their number follows the input, and a stream takes them in two batches."""
    return max(1, -(-len(spark.read.format(kind).load(folder).inputFiles()) // 2))


def stream_ingestion(spark, d):
    """Documents as a stream of files into a register of hash buckets, in two batches; those that are seen or too short left out."""
    from statuta.sources.buckets import read_buckets
    from statuta.streaming.ingest import ingest

    source, register, seen, checkpoint = (scratch_path(spark, n) for n in ("incoming", "register", "seen", "ingest-state"))
    docs = V.table(spark, d, "documents").select(
        F.concat(F.lit("https://x.example.org/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("detail_url"), F.col("doc_id").cast("string").alias("circular_id"),
        F.lit("").alias("title"), F.col("lang").alias("circular_type"), F.lit("").alias("date"), F.col("text").alias("document_text"),
    )
    docs.repartition("circular_id").write.json(source)  # as many files as the texts need
    extract = lambda new: new.select(F.col("circular_id").cast("long").alias("obligation_id"), F.length("document_text").alias("characters"), F.col("circular_type").alias("lang"))
    schema = "obligation_id long, characters int, lang string"
    ingest(spark, source, register, seen, checkpoint, extract, schema, most_files=_half(spark, source, "text"), buckets=16).awaitTermination()
    return read_buckets(spark, register, schema)


def checklist_stream(spark, d):
    """Checklist updates (of line items, a return done is the later state) as a stream that sets the evidence status of a register in buckets: counts by status."""
    from statuta.sources.buckets import read_buckets, upsert_buckets
    from statuta.streaming.ingest import checklist_batch

    register, updates, source, checkpoint = (scratch_path(spark, n) for n in ("register", "updates", "update-files", "checklist-state"))
    schema = "obligation_id long, severity string, evidence_status string"
    upsert_buckets(spark, register, V.register(spark, d).select("obligation_id", "severity", F.lit("red").alias("evidence_status")), schema, buckets=16)
    lines = V.table(spark, d, "lineitem").filter("l_returnflag <> 'N'")
    lines.select(F.col("l_orderkey").alias("obligation_id"), F.col("l_linenumber").cast("string").alias("item_id"), (F.col("l_returnflag") == "R").alias("completed"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("ts")).repartition("obligation_id").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", _half(spark, source, "parquet")).parquet(source)
    stream.writeStream.foreachBatch(checklist_batch(register, updates, schema, buckets=16)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_buckets(spark, register, schema).groupBy("evidence_status").agg(F.count(F.lit(1)).alias("n"))


def merge_sets(spark, d):
    """Two sets that overlap in a third of the documents, which the responses have in a revised wording, merged within their source."""
    from statuta.operators.changes import merge_sets as merge

    n, text = F.col("doc_id"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    docs = V.table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    fixed = [F.col("source").alias("circular_id"), n.alias("order"), F.lit("").alias("required_action"), F.col("lang").alias("responsible_party")]
    local = docs.filter(n % 3 != 2).select(
        *fixed, F.col("text").alias("description"), text("L", n).alias("title"), F.when(n % 4 == 0, "").otherwise(text("day ", n)).alias("deadline"), F.lit("fixed").alias("deadline_type"),
        F.array(F.col("lang"), F.lit("file")).alias("evidence_requirements"), F.array("source").alias("keywords"), (n % 64 / 64.0).alias("confidence_score"),
    )
    response = docs.filter(n % 3 != 0).select(
        *fixed, text("revised ", F.col("text")).alias("description"), F.when(n % 7 == 0, "").otherwise(text("R", n)).alias("title"), F.when(n % 5 == 0, "").otherwise(text("due ", n)).alias("deadline"), F.lit("relative").alias("deadline_type"),
        F.array(text("e", n % 7), F.lit("file")).alias("evidence_requirements"), F.array("lang", "source").alias("keywords"), F.lit(0.8).alias("confidence_score"),
    )
    out = merge(local, response, stops=STOPS)
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("obligation_id", F.col("order").alias("source_id"), "title", "deadline", "deadline_type", join("evidence_requirements"), join("keywords"), F.bround("confidence_score", 6).alias("confidence_score"), "confirmed")


def _gradient_sql() -> str:
    k = len(FEATURES)
    zs = [f"(x{i} - m{i}) / s{i}" for i in range(k)]
    logit = "b + " + " + ".join(f"w{i} * z{i}" for i in range(k))
    return rf"""t AS (SELECT doc_id, source, quality y, coalesce(text, '') t FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
  c AS (SELECT *, greatest(length(t), 1) n, length(t) - length(regexp_replace(t, '\pL', '', 'g')) a, greatest(len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')), 1) w FROM t),
  f AS (SELECT doc_id, y, CAST('0x' || md5(coalesce(source, ''))[1:4] AS INTEGER) % 100 < 30 h, (length(t) - length(regexp_replace(t, '\p{{Nd}}', '', 'g'))) / n::DOUBLE x0, length(regexp_replace(t, '[\pL\pN\s]', '', 'g')) / n::DOUBLE x1,
    CASE WHEN a > 0 THEN (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) / a::DOUBLE ELSE 0 END x2, least((length(t) - length(replace(t, ',', ''))) / w::DOUBLE * 5, 1.0) x3 FROM c),
  facts AS (SELECT count(*)::DOUBLE n, sum(y)::DOUBLE o, {", ".join(f"avg(x{i}) m{i}, coalesce(nullif(stddev_pop(x{i}), 0), 1) s{i}" for i in range(k))} FROM f WHERE NOT h),
  g AS MATERIALIZED (SELECT doc_id, y, h, n, CASE WHEN y = 1 THEN n / (2 * o) ELSE n / (2 * (n - o)) END c, {", ".join(f"{z} z{i}" for i, z in enumerate(zs))} FROM f, facts),
  step AS (SELECT 0 k, 0::DOUBLE b, {", ".join(f"0::DOUBLE w{i}" for i in range(k))} UNION ALL
    SELECT k + 1, any_value(b) - {RATE}::DOUBLE * sum(c * (1 / (1 + exp(-({logit}))) - y)) / any_value(n), {", ".join(f"any_value(w{i}) - {RATE}::DOUBLE * (sum(c * (1 / (1 + exp(-({logit}))) - y) * z{i}) / any_value(n) + {RIDGE}::DOUBLE * any_value(w{i}))" for i in range(k))}
    FROM step, g WHERE NOT h AND k < {STEPS} GROUP BY k),
  last AS (SELECT * FROM step WHERE k = {STEPS}), p AS (SELECT doc_id, y, h, 1 / (1 + exp(-({logit}))) p FROM g, last)"""


GRADIENT = "WITH RECURSIVE " + _gradient_sql()
REPORT = """, q AS (SELECT y, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END r, h FROM p), t1 AS (SELECT count(*) FILTER (NOT h) n, count(*) FILTER (NOT h AND y = 1) o, count(*) FILTER (h) m, avg(y) FILTER (h) s, count(*) FILTER (h AND y = r) / count(*) FILTER (h)::DOUBLE a FROM q),
  cl AS (SELECT v.x, count(*) FILTER (y = v.x) su, count(*) FILTER (r = v.x) pr, count(*) FILTER (y = v.x AND r = v.x) tp FROM q, (VALUES (0), (1)) v(x) WHERE h GROUP BY 1)
  SELECT n train_rows, m test_rows, round_even(CASE WHEN 2 * o >= n THEN s ELSE 1 - s END, 6) baseline, round_even(a, 6) accuracy, (SELECT round_even(avg(CASE WHEN su + pr > 0 THEN 2 * tp / (su + pr)::DOUBLE ELSE 0 END), 6) FROM cl WHERE su > 0) macro_f1 FROM t1"""

STOP_SQL = ", ".join(f"'{s}'" for s in STOPS)
WINDOWS = r"f AS (SELECT doc_id, lang, source, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) t FROM documents)"

QUERIES = [
    (logistic_scores, GRADIENT + " SELECT doc_id, h held_out, round_even(p, 4) probability, CAST(p >= 0.5 AS INTEGER) predicted FROM p"),
    (head_coefficients, GRADIENT + " SELECT 'intercept' AS feature, round_even(b, 6) weight FROM last " + " ".join(f"UNION ALL SELECT '{n}', round_even(w{i}, 6) FROM last" for i, n in enumerate(FEATURES))),
    (training_report, GRADIENT + REPORT),
    (stream_ingestion, "SELECT doc_id obligation_id, CAST(length(text) AS INTEGER) characters, lang FROM documents WHERE length(text) >= 100"),
    (
        checklist_stream,
        "WITH i AS (SELECT l_orderkey k, bool_or(l_returnflag = 'R') r FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, l_linenumber), s AS (SELECT k, count(*) n, count(*) FILTER (r) c FROM i GROUP BY 1) SELECT CASE WHEN c = n THEN 'green' WHEN c > 0 THEN 'yellow' ELSE 'red' END evidence_status, count(*) n FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY 1",
    ),
    (
        merge_sets,
        "WITH " + tf_sql("SELECT doc_id id, coalesce(text, '') AS text FROM documents WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id + 1000000000000, 'revised ' || coalesce(text, '') FROM documents WHERE doc_id % 3 <> 0", 2)
        + """, sims AS (SELECT dr.doc_id r, dl.doc_id l, sum(r.weight * l.weight) s FROM wts r JOIN wts l USING (term) JOIN documents dr ON dr.doc_id = r.id - 1000000000000 JOIN documents dl ON dl.doc_id = l.id WHERE dr.source = dl.source GROUP BY 1, 2),
  best AS (SELECT r, l FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY round(s, 9) DESC, l) n FROM sims WHERE s >= 0.55) WHERE n = 1), claim AS (SELECT min(r) r, l FROM best GROUP BY l),
  a AS (SELECT doc_id id, source, 'L' || doc_id title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'day ' || doc_id END deadline, [lang, 'file'] ev, [source] kw FROM documents WHERE doc_id % 3 <> 2),
  b AS (SELECT doc_id id, source, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'R' || doc_id END title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'due ' || doc_id END deadline, ['e' || doc_id % 7, 'file'] ev, [lang, source] kw FROM documents WHERE doc_id % 3 <> 0),
  own AS (SELECT x.source, x.id, 0 part, coalesce(nullif(r.title, ''), x.title) title, CASE WHEN x.deadline = '' THEN coalesce(nullif(r.deadline, ''), '') ELSE x.deadline END deadline, CASE WHEN x.deadline = '' AND coalesce(r.deadline, '') <> '' THEN 'relative' ELSE 'fixed' END kind,
    CASE WHEN r.id IS NULL THEN x.ev ELSE list_sort(list_distinct(list_concat(x.ev, r.ev)))[1:6] END ev, CASE WHEN r.id IS NULL THEN x.kw ELSE list_sort(list_distinct(list_concat(x.kw, r.kw)))[1:8] END kw,
    CASE WHEN r.id IS NULL THEN (x.id % 64) / 64.0::DOUBLE ELSE round_even(least(1.0::DOUBLE, (x.id % 64) / 64.0::DOUBLE + 0.05::DOUBLE), 3) END c, r.id IS NOT NULL ok FROM a x LEFT JOIN claim ON l = x.id LEFT JOIN b r ON r.id = claim.r),
  every AS (SELECT * FROM own UNION ALL SELECT source, id, 1, title, deadline, 'relative', ev, kw, 0.8::DOUBLE, false FROM b WHERE id NOT IN (SELECT r FROM claim))
  SELECT source || '_obl_' || (row_number() OVER (PARTITION BY source ORDER BY part, id) - 1) AS obligation_id, id source_id, title, deadline, kind deadline_type, array_to_string(ev, ',') evidence_requirements, array_to_string(kw, ',') keywords, round_even(c, 6) confidence_score, ok confirmed FROM every""",
    ),
    (
        explain_terms,
        rf"""WITH t AS (SELECT conv_id || ':' || turn id, coalesce(role, '') r, lower(coalesce(text, '')) s FROM conversations),
  w AS (SELECT id, r, 'word__' || unnest(list_filter(regexp_extract_all(s, '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({STOP_SQL}))) term FROM t),
  ch AS (SELECT id, r, ' ' || unnest(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) || ' ' p FROM t), c3 AS (SELECT id, r, 'char__' || unnest(list_transform(range(1, length(p) - 1), lambda i: p[i : i + 2])) term FROM ch),
  n AS (SELECT id, r, term, count(*) tf FROM (SELECT * FROM w UNION ALL SELECT * FROM c3) GROUP BY 1, 2, 3),
  k AS (SELECT term, round_even(ln((1 + count(*) FILTER (r = 'user'))::DOUBLE / (1 + count(*) FILTER (r <> 'user'))), 6) weight FROM n GROUP BY 1),
  c AS (SELECT id, term, starts_with(term, 'char__') ch, (1 + ln(tf)) * weight v FROM n JOIN k USING (term) WHERE weight <> 0),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(abs(v), 9) DESC, term) n FROM c) WHERE n <= 18),
  l AS (SELECT *, n q FROM o WHERE NOT ch OR n <= 3), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY q) rk FROM l)
  SELECT id, trim(term[7:]) feature, round_even(v, 4) contribution, CASE WHEN v > 0 THEN 'supports' ELSE 'opposes' END direction, rk "rank" FROM z WHERE rk <= 6""",
    ),
    (
        training_windows,
        "WITH " + WINDOWS + ", w AS (SELECT doc_id, lang, source, CASE WHEN t = '' THEN [] WHEN length(t) <= 1200 THEN [t] ELSE list_filter(list_transform(range(0, length(t), 600), lambda i: t[i + 1 : i + 1200]), lambda x: length(x) >= 250) END w FROM f)"
        " SELECT doc_id circular_id, unnest(range(0, len(w))) window_no, md5(unnest(w)) digest, CAST(lang = 'en' AS INTEGER) is_circular, CASE WHEN lang = 'en' THEN source END \"family\" FROM w WHERE len(w) > 0",
    ),
    (
        recognised_documents,
        "WITH " + tf_sql("SELECT doc_id id, text FROM documents", 1) + ", " + WINDOWS
        + f""", ws AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) <= 1200 THEN [t] ELSE list_filter(list_transform(range(0, length(t) - 600, 600), lambda i: t[i + 1 : i + 1200]), lambda x: length(x) >= 250) END w FROM f),
  wn AS (SELECT doc_id, list_filter(string_split(lower(unnest(w)), ' '), lambda x: x <> '') w FROM ws WHERE len(w) > 0),
  sc AS (SELECT doc_id, {", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(m) for m in marks)}))) / greatest(len(w), 1)::DOUBLE {lang}" for lang, marks in FAMILY_WORDS.items())}, len(list_filter(w, lambda x: x IN ({", ".join(repr(m) for marks in FAMILY_WORDS.values() for m in marks)}))) / greatest(len(w), 1)::DOUBLE c FROM wn),
  av AS (SELECT doc_id, avg(c) c, count(*) n, avg(en) en, avg(fr) fr, avg(de) de, avg(es) es FROM sc GROUP BY 1),
  fa AS (SELECT doc_id, l, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, l) k FROM (SELECT doc_id, unnest(['en', 'fr', 'de', 'es']) l, unnest([en, fr, de, es]) p FROM av)),
  fam AS (SELECT lang, count(DISTINCT doc_id) n FROM documents GROUP BY 1), mean AS (SELECT lang, term, sum(weight) / max(n) w FROM wts JOIN documents ON doc_id = id JOIN fam USING (lang) GROUP BY 1, 2), cn AS (SELECT lang, sqrt(sum(w * w)) r FROM mean GROUP BY 1),
  cen AS (SELECT lang, term, w / r w FROM mean JOIN cn USING (lang)), s AS (SELECT id, lang, sum(weight * w) s FROM wts JOIN cen USING (term) GROUP BY 1, 2), b AS (SELECT id, max(s) s FROM s GROUP BY 1)
  SELECT av.doc_id circular_id, round_even(c, 4) circular_confidence, n windows_analysed, l "family", round_even(p, 4) family_confidence, round_even(1 - coalesce(s, 0), 4) novelty, coalesce(s, 0) < 0.6 OR round_even(p, 4) < 0.1 is_novel_topic, round_even(c, 4) >= 0.5 is_circular
  FROM av JOIN fa USING (doc_id) LEFT JOIN b ON id = doc_id WHERE k = 1""",
    ),
]
