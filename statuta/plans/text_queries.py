"""Queries over documents, turns, pages and vectors: lists of (name, query, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import columns as C
from statuta.functions import fields as X
from statuta.functions import lexicon as L
from statuta.operators import changes as CH
from statuta.operators import evaluate as EV
from statuta.operators import evidence as E
from statuta.operators import insights as I
from statuta.operators import similarity as S
from statuta.operators import text as T
from statuta.plans import views as V
from statuta.sources import readers as RD

#: Words that occur in the given documents; operators take any list.
MARKERS = ("the", "that", "with", "les", "der", "no")
STOPS = ("the", "and", "of", "to", "in", "de", "la", "les", "der", "die", "que", "el", "et", "und")
CLEAN = r"""clean AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '(?im)^\s*(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*$', '', 'g'), '(\w)-\n(\w)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) t FROM documents)"""
LINE = r"trim(x, ' ' || chr(10) || chr(9))"
BLOCKS = (
    CLEAN
    + rf""", marked AS (SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN {LINE} = '' THEN chr(1)
    WHEN length({LINE}) <= 80 AND len(list_filter(string_split({LINE}, ' '), lambda y: y <> '')) <= 10 AND NOT regexp_matches({LINE}, '[.;:]$') AND regexp_matches({LINE}, '^(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][A-Za-z][A-Za-z ,&/()''-]{{3,70}}$') THEN chr(1) || 'heading' || chr(2) || {LINE} || chr(1)
    WHEN regexp_matches({LINE}, '^\s*(?:\(?\d+(?:\.\d+)*\)?[.)]?|\([a-z]{{1,3}}\)|\([ivxl]{{1,5}}\))\s+') THEN chr(1) || 'clause' || chr(2) || {LINE} ELSE {LINE} END), ' ') m FROM clean),
  pieces AS (SELECT doc_id, unnest(string_split(m, chr(1))) p, generate_subscripts(string_split(m, chr(1)), 1) i FROM marked),
  blocks AS (SELECT doc_id, i, CASE WHEN contains(p, chr(2)) THEN split_part(p, chr(2), 1) ELSE 'text' END kind, trim(regexp_replace(split_part(p, chr(2), -1), '\s+', ' ', 'g')) b FROM pieces)"""
)

#: SQL of the sentences of each document (table sents), after that of its blocks.
SENTENCES = BLOCKS + r""", frags AS (SELECT doc_id, i, unnest(f) s, generate_subscripts(f, 1) k FROM (SELECT doc_id, i, string_split(regexp_replace(b, '([.!?;])\s+', '\1' || chr(3), 'g'), chr(3)) f FROM blocks WHERE b <> '')),
  ordered AS (SELECT doc_id, trim(s) s, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) n FROM frags WHERE trim(s) <> ''),
  glued AS (SELECT doc_id, string_agg(CASE WHEN n > 1 AND lower(split_part(rtrim(s, '.'), ' ', -1)) IN ('no','nos','vs','viz','etc','i.e','e.g','sec','cl','pvt','ltd','sr','dr','mr','ms','hon','para','fig','rs') THEN ' ' ELSE chr(1) END || s, '' ORDER BY n) g FROM ordered GROUP BY 1),
  sents AS (SELECT doc_id, list_filter(string_split(g, chr(1)), lambda x: length(x) > 2) s FROM glued)"""


def marker_counts(spark, d):
    rows = V.documents(spark, d).select("circular_id", C.marker_counts(F.lower(F.coalesce("document_text", F.lit(""))), MARKERS).alias("m"))
    return rows.select("circular_id", *[F.coalesce(F.element_at("m", m), F.lit(0)).alias(f"n_{m}") for m in MARKERS])


def block_counts(spark, d):
    return T.blocks(V.documents(spark, d)).groupBy("circular_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("characters"))


def sentence_split(spark, d):
    rows = V.documents(spark, d).select("circular_id", T.split_sentences(F.col("document_text")).alias("s"))
    return rows.select("circular_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


def doc_profile(spark, d):
    out = I.profile(V.documents(spark, d), mandatory=MARKERS[:2], prohibition=MARKERS[5:], discretionary=MARKERS[2:5])
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0), lambda a, b: a + b)
    return out.select("circular_id", "characters", "sentences", "paragraphs", "longest_sentence_words", total("mandatory_language").alias("mandatory"), total("discretionary_language").alias("discretionary"))


def unit_sections(spark, d):
    return I.section_profile(T.units(V.documents(spark, d)), markers=MARKERS[:2])


def keyword_profile(spark, d):
    return I.keyword_profile(V.documents(spark, d), stops=STOPS).select("circular_id", "term", "count", "rank")


def windows_1200(spark, d):
    return T.windows(V.documents(spark, d)).select("circular_id", "window_no", F.md5("text").alias("digest"))


def passage_packing(spark, d):
    return T.passages(V.documents(spark, d)).select("circular_id", "passage_id", F.length("text").alias("characters"), "section")


def text_chunks(spark, d):
    return T.chunks(V.documents(spark, d)).select("circular_id", "chunk_no", F.length("text").alias("characters"), "section_hint")


def document_metadata(spark, d):
    return T.metadata(V.documents(spark, d), reference=r"\b[A-Z]{2,5}-\d{2,6}\b").select("circular_id", "reference", F.md5("subject").alias("subject"))


def modality_features(spark, d):
    t = F.coalesce("text", F.lit(""))
    f = X.modality_features(t)
    return V.turns(spark, d).select("circular_id", "id", *[F.bround(f[n], 6).alias(n) for n in ("len_words_norm", "digit_ratio", "comma_density")], f["ends_with_period"].cast("int").alias("ends_with_period"))


def field_extraction(spark, d):
    """All derived fields of every sentence that the rule scorer takes, over whole documents."""
    from statuta.operators.classify import extract_obligations

    docs = V.documents(spark, d).withColumn("title", F.concat(F.lit("Document "), F.col("circular_id").cast("string")))
    found = extract_obligations(docs, threshold=0.1)
    lists = [c for c, kind in found.dtypes if kind == "array<string>"]
    return found.withColumns({c: F.array_join(c, "\n") for c in lists} | {"evidence_checklist": F.to_json("evidence_checklist")})


def last_six_turns(spark, d):
    from statuta.operators.reports import dialogue_window

    return dialogue_window(V.turns(spark, d), "circular_id", "id")


def html_links(spark, d):
    return RD.links(V.table(spark, d, "pages")).select("page_id", "href", "title")


def attachment_url(spark, d):
    return V.table(spark, d, "pages").select("page_id", RD.attachment_url(F.col("html"), r"""<iframe[^>]*src\s*=\s*["']([^"']+)["']""", r"""(?i)href\s*=\s*["']([^"']*[0-9]+)["']""").alias("url"))


def newest_per_slug(spark, d):
    pages = V.table(spark, d, "pages")
    return RD.newest_per_slug(pages, F.regexp_extract("url", r"://([^/]+)/", 1), F.col("page_id")).select("base_slug", "page_id")


def tfidf_weights(spark, d):
    texts = V.turns(spark, d).select(F.concat_ws(":", F.col("circular_id").cast("string"), F.col("id").cast("string")).alias("id"), "text")
    return S.tfidf(texts, stops=STOPS).select("id", "term", F.bround("weight", 6).alias("weight"))


def link_by_similarity(spark, d):
    docs = V.table(spark, d, "documents").select(F.col("source").alias("circular_id"), F.col("doc_id").alias("id"), "text")
    return S.link_by_similarity(docs, at_least=0.3, stops=STOPS).select("circular_id", "a", "b", F.bround("similarity", 6).alias("similarity"), "rank")


def _questions(spark, d):
    return V.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def _doc_passages(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text", F.col("source").alias("section"))


def passage_retrieval(spark, d):
    return S.retrieve(_doc_passages(spark, d), _questions(spark, d), stops=STOPS).select("question_id", "passage_id", F.bround("score", 5).alias("score"))


def overlap_retrieval(spark, d):
    return S.overlap_retrieve(_doc_passages(spark, d), _questions(spark, d)).select("question_id", "passage_id", F.bround("score", 6).alias("score"))


def extractive_answers(spark, d):
    found = S.overlap_retrieve(_doc_passages(spark, d), _questions(spark, d))
    return S.answers(found, _doc_passages(spark, d), _questions(spark, d)).select("question_id", F.md5("answer").alias("answer"))


def knn_l2(spark, d):
    vectors = V.table(spark, d, "embeddings")
    return S.nearest_vectors(vectors, vectors.filter("vec_id % 100 = 0"), k=5, at_least=0.3).select("query_id", "vec_id", F.bround("similarity", 5).alias("similarity"))


def centroid_novelty(spark, d):
    texts = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("family"), "text")
    vectors = S.family_texts(texts, stops=STOPS)
    return S.family_novelty(vectors, S.family_means(vectors, texts)).select("id", "family", F.bround("similarity", 5).alias("similarity"))


def _obligations(spark, d):
    t = F.coalesce("document_text", F.lit(""))
    return V.documents(spark, d).select(
        F.col("circular_id").alias("obligation_id"), F.lit("").alias("title"), t.alias("description"), F.lit(None).cast("string").alias("deadline"), F.lit("not_specified").alias("deadline_type"),
        F.when(F.length(t) > 2000, "high").otherwise("low").alias("severity"), F.col("source").alias("responsible_party"), F.array("lang").alias("intermediary_types"), F.array().cast("array<string>").alias("evidence_requirements"),
    )


def lexical_diff(spark, d):
    """Every hundredth document against all the others."""
    rows = _obligations(spark, d)
    asked = F.col("obligation_id") % 100 == 0
    return CH.lexical_diff(rows.filter(asked), rows.filter(~asked), stops=STOPS).select("new_id", "old_id", "change_class", F.bround("similarity", 5).alias("similarity"), F.array_join("changes", "\n").alias("changes"))


def diff_impact(spark, d):
    rows = _obligations(spark, d)
    asked = F.col("obligation_id") % 100 == 0
    return CH.impact_score(CH.lexical_diff(rows.filter(asked), rows.filter(~asked), stops=STOPS))


def greedy_one_to_one(spark, d):
    pairs = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.min("l_partkey").alias("b"))
    return CH.claim_once(pairs).select("a", "b", "claimed")


def token_overlap_match(spark, d):
    docs = V.table(spark, d, "documents")
    truth = V.table(spark, d, "benchmark").select(F.lit(0).alias("doc"), F.col("item_id").alias("id"), "text")
    return EV.overlap_matches(docs.select(F.lit(0).alias("doc"), F.col("doc_id").alias("id"), "text"), truth).select("pred_id", "truth_id", F.bround("overlap", 6).alias("overlap"))


def evidence_match(spark, d):
    docs = V.table(spark, d, "documents").select((F.col("doc_id") % 40).alias("obligation_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), "text")
    wanted = V.table(spark, d, "benchmark").select(F.col("item_id").alias("obligation_id"), F.filter(F.split("text", r"\. "), lambda s: s != "").alias("evidence_requirements"))
    return E.roll_up(E.match(docs, wanted)).select("filename", F.size("matched").alias("matched"), F.size("unmatched").alias("unmatched"), F.bround("overall_score", 6).alias("overall_score"), "evidence_status")


def _predicted(spark, d):
    rows = V.table(spark, d, "documents").join(V.table(spark, d, "labels"), "doc_id")
    odd = F.length(F.col("text")) - F.length(F.translate("text", "!|$%&*#", ""))
    return rows.select(F.col("quality").alias("label"), F.when(odd * 20 > F.length("text"), 0).otherwise(1).alias("predicted"))


def confusion_metrics(spark, d):
    return EV.per_class(EV.confusion(_predicted(spark, d))).select("value", "support", *[F.bround(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def overall_metrics(spark, d):
    return EV.overall(EV.confusion(_predicted(spark, d))).select(F.bround("accuracy", 6).alias("accuracy"), "support", F.bround("macro_f1", 6).alias("macro_f1"))


def label_distribution(spark, d):
    return EV.label_distribution(V.table(spark, d, "labels"), ["quality", "toxic"])


def tf_sql(source: str, longest: int, sublinear: bool = False) -> str:
    """SQL of weights: tables toks(id, w) and wts(id, term, df, weight) from ``source`` with id and text."""
    stop = ", ".join(f"'{s}'" for s in STOPS)
    grams = "SELECT id, unnest(w) term FROM toks"
    if longest == 2:
        grams += " UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks WHERE len(w) > 1"
    tf = "1 + ln(tf)" if sublinear else "tf"
    return rf"""toks AS (SELECT id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({stop})) w FROM ({source})),
  grams AS ({grams}), cnt AS (SELECT id, term, count(*) tf FROM grams GROUP BY 1, 2), ndoc AS (SELECT count(DISTINCT id) n FROM cnt), dfs AS (SELECT term, count(*) df FROM cnt GROUP BY 1),
  raw AS (SELECT id, term, df, ({tf})::DOUBLE * (ln((1 + n)::DOUBLE / (1 + df)) + 1) w FROM cnt JOIN dfs USING (term), ndoc), nrm AS (SELECT id, sqrt(sum(w * w)) r FROM raw GROUP BY 1), wts AS (SELECT id, term, df, w / r weight FROM raw JOIN nrm USING (id))"""


DIFF = (
    "WITH "
    + tf_sql("SELECT doc_id id, ' ' || coalesce(text, '') AS text FROM documents", 2, True)
    + """, sims AS (SELECT a.id a, b.id b, sum(a.weight * b.weight) s FROM wts a JOIN wts b USING (term) WHERE a.id % 100 = 0 AND b.id % 100 <> 0 GROUP BY 1, 2),
  best AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, CAST(b AS VARCHAR)) n FROM sims WHERE s >= 0.62) WHERE n = 1),
  docs AS (SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'high' ELSE 'low' END sev, source, lang FROM documents),
  joined AS (SELECT CAST(x.doc_id AS VARCHAR) new_id, CAST(b AS VARCHAR) old_id, s, CASE WHEN b IS NOT NULL AND s < 0.92 THEN list_filter([CASE WHEN x.sev <> o.sev THEN 'severity: ' || o.sev || ' → ' || x.sev END,
    CASE WHEN x.source <> o.source THEN 'responsible party: ''' || o.source || ''' → ''' || x.source || '''' END, CASE WHEN x.lang <> o.lang THEN 'now also applies to: ' || x.lang END, CASE WHEN x.lang <> o.lang THEN 'no longer applies to: ' || o.lang END], lambda z: z IS NOT NULL) ELSE [] END ch
    FROM docs x LEFT JOIN best ON a = x.doc_id LEFT JOIN docs o ON o.doc_id = b WHERE x.doc_id % 100 = 0),
  diff AS (SELECT new_id, old_id, CASE WHEN old_id IS NULL THEN 'NEW' WHEN s < 0.92 AND len(ch) > 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END change_class, round_even(s, 5) similarity, array_to_string(ch, chr(10)) changes FROM joined)"""
)

LABELLED = """WITH p AS (SELECT quality label, CASE WHEN (length(text) - length(regexp_replace(text, '[!|$%&*#]', '', 'g'))) * 20 > length(text) THEN 0 ELSE 1 END predicted FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT v.x AS value, count(*) FILTER (label = v.x) support, count(*) FILTER (predicted = v.x) pr, count(*) FILTER (label = v.x AND predicted = v.x) tp FROM p, (VALUES (0), (1)) v(x) GROUP BY 1),
  m AS (SELECT "value", support, CASE WHEN pr > 0 THEN tp / pr::DOUBLE ELSE 0 END p, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END r FROM c)"""

QUERIES = [
    (marker_counts, "SELECT doc_id circular_id, " + ", ".join(f"CAST((length(t) - length(replace(t, '{m}', ''))) / {len(m)} AS INTEGER) n_{m}" for m in MARKERS) + " FROM (SELECT doc_id, lower(coalesce(text, '')) t FROM documents)"),
    (block_counts, "WITH " + BLOCKS + " SELECT doc_id circular_id, kind, count(*) n, sum(length(b)) characters FROM blocks WHERE b <> '' GROUP BY 1, 2"),
    (
        sentence_split,
        "WITH "
        + SENTENCES
        + """
  SELECT d.doc_id circular_id, coalesce(len(s), 0) sentences, md5(coalesce(array_to_string(s, chr(10)), '')) digest FROM documents d LEFT JOIN sents USING (doc_id)""",
    ),
    (
        doc_profile,
        "WITH "
        + SENTENCES
        + r"""
  SELECT c.doc_id circular_id, CAST(length(t) AS INTEGER) characters, CAST(coalesce(len(s), 0) AS INTEGER) sentences, CAST(len(list_filter(regexp_split_to_array(t, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))) AS INTEGER) paragraphs,
    CAST(coalesce(list_max(list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')))), 0) AS INTEGER) longest_sentence_words, """
        + ", ".join(" + ".join(f"CAST((length(t) - length(replace(lower(t), '{m}', ''))) / {len(m)} AS INTEGER)" for m in marks) + f" {name}" for name, marks in (("mandatory", MARKERS[:2]), ("discretionary", MARKERS[2:5])))
        + " FROM clean c LEFT JOIN sents ON sents.doc_id = c.doc_id",
    ),
    (
        unit_sections,
        "WITH "
        + BLOCKS
        + rf""", nb AS (SELECT doc_id, i, kind, b, kind = 'heading' AND NOT regexp_matches(trim(b), '(?i){L.NOT_A_SECTION}') AND (regexp_matches(b, '{L.SECTION_HEADING}') OR (b = upper(b) AND b <> lower(b) AND len(list_filter(string_split(b, ' '), lambda x: x <> '')) BETWEEN 2 AND 10)) sh FROM blocks WHERE b <> ''),
  carried AS (SELECT doc_id, i, kind, b, coalesce(last_value(CASE WHEN sh THEN trim(b) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'General') sec FROM nb),
  body AS (SELECT doc_id, i, sec, trim(regexp_replace(b, '{L.CLAUSE_NUMBER}', '')) t FROM carried WHERE kind <> 'heading'),
  fr AS (SELECT doc_id, i, sec, unnest(f) s, generate_subscripts(f, 1) k FROM (SELECT doc_id, i, sec, string_split(regexp_replace(CASE WHEN regexp_matches(t, '(?i)^\s*(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*$') THEN '' ELSE t END, '([.!?;])\s+', '\1' || chr(3), 'g'), chr(3)) f FROM body)),
  od AS (SELECT doc_id, i, sec, trim(s) s, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) n FROM fr WHERE trim(s) <> ''),
  gl AS (SELECT doc_id, i, sec, string_agg(CASE WHEN n > 1 AND list_contains([{", ".join(f"'{a}'" for a in L.ABBREVIATIONS)}], lower(split_part(rtrim(s, '.'), ' ', -1))) THEN ' ' ELSE chr(1) END || s, '' ORDER BY n) g FROM od GROUP BY 1, 2, 3),
  us AS (SELECT doc_id, i, sec, unnest(f) s, generate_subscripts(f, 1) k FROM (SELECT doc_id, i, sec, list_filter(string_split(g, chr(1)), lambda x: length(x) > 2) f FROM gl)),
  un AS (SELECT doc_id, sec, s, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) o FROM us)
  SELECT doc_id circular_id, sec[1:70] AS "section", count(*) sentences, count(*) FILTER (contains(lower(s), 'the') OR contains(lower(s), 'that')) mandatory_sentences, CAST(min(o) AS INTEGER) AS "first" FROM un GROUP BY doc_id, sec""",
    ),
    (
        keyword_profile,
        f"""WITH toks AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z-]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{s}'" for s in STOPS)})) w FROM documents),
  g AS (SELECT doc_id, unnest(w) term, generate_subscripts(w, 1) - 1 p, 1 k FROM toks UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), unnest(range(1, len(w))), 2 FROM toks WHERE len(w) > 1),
  c AS (SELECT doc_id, term, k, count(*) n, min(p) f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3), r AS (SELECT doc_id circular_id, term, n * k "count", row_number() OVER (PARTITION BY doc_id ORDER BY n * k DESC, k DESC, f, term) "rank" FROM c)
  SELECT * FROM r WHERE "rank" <= 18""",
    ),
    (
        windows_1200,
        r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) t FROM documents), w AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) <= 1200 THEN [t] ELSE list_filter(list_transform(range(0, length(t) - 600, 600), lambda i: t[i + 1 : i + 1200]), lambda x: length(x) >= 250) END w FROM f)
  SELECT doc_id circular_id, unnest(range(0, len(w))) window_no, md5(unnest(w)) digest FROM w WHERE len(w) > 0""",
    ),
    (
        passage_packing,
        "WITH RECURSIVE "
        + BLOCKS
        + """, nb AS MATERIALIZED (SELECT doc_id, kind, b, length(b) l, row_number() OVER (PARTITION BY doc_id ORDER BY i) n FROM blocks WHERE b <> ''),
  r AS (SELECT DISTINCT doc_id, 0::BIGINT n, 0::BIGINT s, false o, 0::BIGINT c, 'General' h, true head FROM nb UNION ALL
    SELECT nb.doc_id, nb.n, CASE WHEN kind = 'heading' THEN 0 WHEN o AND s + l > 900 THEN l ELSE s + l END, kind <> 'heading', c + CASE WHEN o AND (kind = 'heading' OR s + l > 900) THEN 1 ELSE 0 END, CASE WHEN kind = 'heading' THEN b ELSE h END, kind = 'heading' FROM r JOIN nb ON nb.doc_id = r.doc_id AND nb.n = r.n + 1),
  p AS (SELECT doc_id, c, sum(l) + count(*) - 1 k, any_value(h) h FROM r JOIN nb USING (doc_id, n) WHERE NOT head GROUP BY 1, 2)
  SELECT doc_id circular_id, 'p' || lpad(CAST(c AS VARCHAR), CAST(greatest(3, length(CAST(c AS VARCHAR))) AS INTEGER), '0') passage_id, CAST(k AS INTEGER) characters, h AS "section" FROM p WHERE k > 40""",
    ),
    (
        text_chunks,
        r"""WITH RECURSIVE ln AS (SELECT doc_id, unnest(list_transform(range(1, len(x) + 1), lambda i: x[i] || CASE WHEN i < len(x) THEN chr(10) ELSE '' END)) l, unnest(range(1, len(x) + 1)) n FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents WHERE text IS NOT NULL)),
  hd AS MATERIALIZED (SELECT doc_id, l, n, regexp_replace(regexp_extract(l, '^((?:\d+\.)+\d*\s+[A-Z][^\n]{3,80}|[A-Z][A-Z\s]{4,60}|(?:PART|CHAPTER|SECTION)\s+\w+)', 1), '^\s+|\s+$', '', 'g') h FROM ln),
  r AS (SELECT DISTINCT doc_id, 0::BIGINT n, '' b, 'General' s, 0::BIGINT c, NULL::VARCHAR e, '' es FROM hd UNION ALL
    SELECT q.doc_id, q.n, CASE WHEN cut THEN q.l WHEN length(q.b || q.l) >= 6000 THEN '' ELSE q.b || q.l END, CASE WHEN cut THEN h ELSE s END, c + CASE WHEN cut OR length(q.b || q.l) >= 6000 THEN 1 ELSE 0 END,
      CASE WHEN cut THEN t WHEN length(q.b || q.l) >= 6000 THEN regexp_replace(q.b || q.l, '^\s+|\s+$', '', 'g') END, s
    FROM (SELECT hd.doc_id, hd.n, hd.l, hd.h, r.b, r.s, r.c, regexp_replace(r.b, '^\s+|\s+$', '', 'g') t, hd.h <> '' AND length(regexp_replace(r.b, '^\s+|\s+$', '', 'g')) > 200 cut FROM r JOIN hd ON hd.doc_id = r.doc_id AND hd.n = r.n + 1) q),
  z AS (SELECT doc_id, c - 1 k, e, es FROM r WHERE e IS NOT NULL UNION ALL SELECT doc_id, c, regexp_replace(b, '^\s+|\s+$', '', 'g'), s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) x FROM r) WHERE x = 1 AND regexp_matches(b, '\S'))
  SELECT doc_id circular_id, k chunk_no, CAST(length(e) AS INTEGER) characters, es section_hint FROM z""",
    ),
    (
        document_metadata,
        r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') l FROM documents),
  m AS (SELECT doc_id, regexp_extract(list_filter(l[1:15], lambda x: regexp_matches(x, '(?i)\b[A-Z]{2,5}-\d{2,6}\b'))[1], '(?i)\b[A-Z]{2,5}-\d{2,6}\b') ref, regexp_extract(list_filter(l[1:25], lambda x: regexp_matches(x, '(?i)^(?:sub(?:ject)?|re)\s*[:\-]'))[1], '(?i)^(?:sub(?:ject)?|re)\s*[:\-]\s*(.*)$', 1) sub,
    list_filter(l[1:25], lambda x: length(x) > 20 AND x <> upper(x))[1] plain, l[2] other FROM l)
  SELECT doc_id circular_id, ref AS reference, md5(coalesce(nullif(trim(sub), ''), plain, other)) subject FROM m""",
    ),
    (
        modality_features,
        r"""WITH t AS (SELECT conv_id circular_id, turn id, coalesce(text, '') s FROM conversations), w AS (SELECT *, greatest(len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')), 1) n, greatest(length(s), 1) c FROM t)
  SELECT circular_id, id, round_even(least(n / 60.0::DOUBLE, 1.0), 6) len_words_norm, round_even((length(s) - length(regexp_replace(s, '[0-9]', '', 'g'))) / c::DOUBLE, 6) digit_ratio, round_even(least((length(s) - length(replace(s, ',', ''))) / n::DOUBLE * 5, 1.0), 6) comma_density,
  CASE WHEN regexp_matches(s, '\.\s*$') THEN 1 ELSE 0 END ends_with_period FROM w""",
    ),
    (field_extraction, None),
    (
        last_six_turns,
        "SELECT conv_id circular_id, string_agg(role || ': ' || coalesce(text, '')[1:600], chr(10) ORDER BY turn) dialogue FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) n FROM conversations) WHERE n <= 6 GROUP BY 1",
    ),
    (
        html_links,
        r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) a FROM pages),
  l AS (SELECT page_id, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) href, trim(regexp_replace(regexp_replace(regexp_extract(a, '(?is)>(.*)</a>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) title FROM a)
  SELECT * FROM l WHERE href <> '' AND title <> '' AND NOT regexp_matches(lower(href), '^javascript:')""",
    ),
    (attachment_url, r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '<iframe[^>]*src\s*=\s*["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(html, '(?i)href\s*=\s*["'']([^"'']*[0-9]+)["'']', 1), '')) url FROM pages"""),
    (newest_per_slug, r"SELECT regexp_replace(regexp_extract(url, '://([^/]+)/', 1), '_\d+$', '') base_slug, min(page_id) page_id FROM pages GROUP BY 1"),
    (tfidf_weights, "WITH " + tf_sql("SELECT conv_id || ':' || turn id, text FROM conversations", 2) + " SELECT id, term, round_even(weight, 6) weight FROM wts"),
    (
        link_by_similarity,
        f"""WITH toks AS (SELECT source g, doc_id id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{s}'" for s in STOPS)})) w FROM documents),
  grams AS (SELECT g, id, unnest(w) term FROM toks UNION ALL SELECT g, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM toks WHERE len(w) > 1), cnt AS (SELECT g, id, term, count(*) tf FROM grams GROUP BY 1, 2, 3),
  ndoc AS (SELECT g, count(DISTINCT id) n FROM cnt GROUP BY 1), dfs AS (SELECT g, term, count(*) df FROM cnt GROUP BY 1, 2), raw AS (SELECT g, id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) w FROM cnt JOIN dfs USING (g, term) JOIN ndoc USING (g)),
  nrm AS (SELECT g, id, sqrt(sum(w * w)) r FROM raw GROUP BY 1, 2), wts AS (SELECT g, id, term, w / r weight FROM raw JOIN nrm USING (g, id)),
  sims AS (SELECT x.g, x.id a, y.id b, sum(x.weight * y.weight) s FROM wts x JOIN wts y USING (g, term) WHERE x.id <> y.id GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY round(s, 9) DESC, b) n FROM sims WHERE s >= 0.3)
  SELECT g circular_id, a, b, round_even(s, 6) similarity, n "rank" FROM r WHERE n <= 2""",
    ),
    (
        passage_retrieval,
        "WITH "
        + tf_sql("SELECT doc_id id, text FROM documents", 2, True)
        + f""", qtok AS (SELECT item_id q, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{s}'" for s in STOPS)})) w FROM benchmark),
  qg AS (SELECT q, unnest(w) term FROM qtok UNION ALL SELECT q, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM qtok WHERE len(w) > 1), qc AS (SELECT q, term, count(*) tf FROM qg GROUP BY 1, 2),
  qr AS (SELECT q, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) w FROM qc JOIN dfs USING (term), ndoc), qn AS (SELECT q, sqrt(sum(w * w)) r FROM qr GROUP BY 1), qw AS (SELECT q, term, w / r w FROM qr JOIN qn USING (q)),
  sims AS (SELECT q, id, sum(w * weight) s FROM qw JOIN wts USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, id) n FROM sims) SELECT q question_id, id passage_id, round_even(s, 5) score FROM r WHERE n <= 5 AND s > 0""",
    ),
    (
        overlap_retrieval,
        """WITH q AS (SELECT item_id q, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) w FROM benchmark), qe AS (SELECT q, len(w) n, unnest(w) t FROM q), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) t FROM documents),
  s AS (SELECT q, doc_id, count(*) / max(n)::DOUBLE s FROM qe JOIN d USING (t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc_id) k FROM s) SELECT q question_id, doc_id passage_id, round_even(s, 6) score FROM r WHERE k <= 5""",
    ),
    (
        extractive_answers,
        """WITH q AS (SELECT item_id q, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) w FROM benchmark), qe AS (SELECT q, len(w) n, unnest(w) t FROM q), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) t FROM documents),
  s AS (SELECT q, doc_id, count(*) / max(n)::DOUBLE s FROM qe JOIN d USING (t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, doc_id) k FROM s),
  a AS (SELECT q, string_agg('**' || source || '** (relevance ' || printf('%.2f', floor(s * 100 + 0.5) / 100) || ')' || chr(10) || CASE WHEN length(text) > 600 THEN text[1:600] || '…' ELSE text END, chr(10) || chr(10) ORDER BY k) b FROM r JOIN documents USING (doc_id) WHERE k <= 3 GROUP BY 1)
  SELECT item_id question_id, md5(coalesce('Most relevant passages:' || chr(10) || chr(10) || b, 'Nothing in the index has a word of this question.')) answer FROM benchmark LEFT JOIN a ON q = item_id""",
    ),
    (
        knn_l2,
        """WITH s AS (SELECT q.vec_id query_id, v.vec_id, 1 / (1 + list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) n FROM s WHERE s >= 0.3) SELECT query_id, vec_id, round_even(s, 5) similarity FROM r WHERE n <= 5""",
    ),
    (
        centroid_novelty,
        "WITH "
        + tf_sql("SELECT doc_id id, text FROM documents", 1)
        + """, fam AS (SELECT lang, count(DISTINCT doc_id) n FROM documents GROUP BY 1), mean AS (SELECT lang, term, sum(weight) / max(n) w FROM wts JOIN documents ON doc_id = id JOIN fam USING (lang) GROUP BY 1, 2), cn AS (SELECT lang, sqrt(sum(w * w)) r FROM mean GROUP BY 1),
  cen AS (SELECT lang, term, w / r w FROM mean JOIN cn USING (lang)), s AS (SELECT id, lang, sum(weight * w) s FROM wts JOIN cen USING (term) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, lang) n FROM s) SELECT id, lang AS "family", round_even(s, 5) similarity FROM b WHERE n = 1""",
    ),
    (lexical_diff, DIFF + " SELECT * FROM diff"),
    (
        diff_impact,
        DIFF
        + """ SELECT count(*) FILTER (change_class = 'NEW') "new", count(*) FILTER (change_class = 'MODIFIED') modified, count(*) FILTER (change_class = 'UNCHANGED') unchanged, round_even(least(1.0::DOUBLE, (count(*) FILTER (change_class = 'NEW') + 0.5::DOUBLE * count(*) FILTER (change_class = 'MODIFIED')) / count(*)), 3) impact_score FROM diff""",
    ),
    (greedy_one_to_one, "WITH p AS (SELECT l_orderkey a, min(l_partkey) b FROM lineitem GROUP BY 1) SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY a) = 1 claimed FROM p"),
    (
        token_overlap_match,
        """WITH q AS (SELECT item_id t, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) w FROM benchmark), d AS (SELECT doc_id p, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) w FROM documents), qe AS (SELECT t, len(w) n, unnest(w) x FROM q), de AS (SELECT p, len(w) n, unnest(w) x FROM d),
  s AS (SELECT p, t, count(*) / least(max(qe.n), max(de.n))::DOUBLE o FROM qe JOIN de USING (x) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o DESC, t) n FROM s WHERE o >= 0.6) SELECT p pred_id, t truth_id, round_even(o, 6) overlap FROM r WHERE n = 1""",
    ),
    (
        evidence_match,
        r"""WITH r AS (SELECT item_id, unnest(list_filter(string_split(text, '. '), lambda x: x <> '')) r FROM benchmark), m AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(r), '\s+'), lambda x: x <> '') w, lower(text) t FROM documents JOIN r ON item_id = doc_id % 40 WHERE text IS NOT NULL),
  s AS (SELECT doc_id, len(list_filter(w, lambda x: contains(t, x))) / greatest(len(w), 1)::DOUBLE >= 0.5 ok FROM m), g AS (SELECT doc_id, count(*) FILTER (ok) matched, count(*) FILTER (NOT ok) unmatched, count(*) FILTER (ok) / count(*)::DOUBLE o FROM s GROUP BY 1)
  SELECT 'f' || doc_id AS filename, matched, unmatched, round_even(o, 6) overall_score, CASE WHEN o >= 0.8 THEN 'green' WHEN o >= 0.4 THEN 'yellow' ELSE 'red' END evidence_status FROM g""",
    ),
    (confusion_metrics, LABELLED + ' SELECT "value", support, round_even(p, 6) "precision", round_even(r, 6) recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) f1 FROM m'),
    (
        overall_metrics,
        LABELLED + " SELECT (SELECT round_even(count(*) FILTER (label = predicted) / count(*)::DOUBLE, 6) FROM p) accuracy, (SELECT count(*) FROM p) support, (SELECT round_even(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) FROM m WHERE support > 0) macro_f1",
    ),
    (label_distribution, "SELECT 'quality' AS \"label\", CAST(quality AS VARCHAR) \"value\", count(*) n FROM labels GROUP BY 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 2"),
]
