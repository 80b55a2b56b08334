"""Sentence and document classifiers: datasets, features, training, scoring, explanation, extraction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from statuta.functions import fields as X
from statuta.functions import lexicon as L
from statuta.functions.columns import folded, let
from statuta.operators import similarity as S
from statuta.operators import text as T
from statuta.session import materialize, scratch_path

DENSE = (
    "has_deontic", "has_prohibition", "has_discretion", "modal_followed_by_verb", "names_party", "has_timeline", "has_evidence_noun", "len_words_norm", "digit_ratio", "caps_ratio", "punct_ratio",
    "dot_leader", "trailing_page_number", "reference_only", "is_definition", "starts_with_clause_number", "ends_with_period", "comma_density", "annexure_index_run", "starts_with_annexure",
)


class ModalityFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage that adds the modality features of a text column as an array of doubles."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def get_feature_names_out(self) -> list[str]:
        return list(DENSE)

    def _transform(self, df: DataFrame) -> DataFrame:
        f = X.modality_features(F.coalesce(F.col(self.getInputCol()), F.lit("")))
        return df.withColumn(self.getOutputCol(), F.array(*[f[n].cast("double") for n in DENSE]))


def labelled_sentences(specs: DataFrame, noise: DataFrame | None = None, noise_documents: int = 5) -> DataFrame:
    """(text, doc_id, is_obligation, severity, category, deadline_type, template_id) from nested document specs.

    Clauses give their labels to their sentences; preamble, closing and addressees are negatives; noise lines
    (line_no, text) are spread over ``noise_documents`` pseudo-documents.
    """
    clause = specs.select("circular_id", F.explode("sections").alias("s")).select("circular_id", F.explode("s.clauses").alias("c"))
    none = F.lit(None).cast("string")
    hits = clause.select(
        F.explode(T.block_sentences(F.col("c.text"))).alias("text"), F.col("circular_id").alias("doc_id"), F.col("c.is_obligation").cast("int").alias("is_obligation"),
        "c.severity", "c.category", "c.deadline_type", "c.template_id",
    )
    around = specs.select("circular_id", F.explode(F.concat("preamble", "closing", "addressees")).alias("t"))
    rest = around.select(F.explode(T.block_sentences(F.col("t"))).alias("text"), F.col("circular_id").alias("doc_id"), F.lit(0).alias("is_obligation"), none.alias("severity"), none.alias("category"), none.alias("deadline_type"), F.lit("recital").alias("template_id"))
    out = hits.unionByName(rest)
    if noise is not None:
        out = out.unionByName(noise.select("text", F.concat(F.lit("noise_"), F.pmod("line_no", F.lit(noise_documents)).cast("string")).alias("doc_id"), F.lit(0).alias("is_obligation"), none.alias("severity"), none.alias("category"), none.alias("deadline_type"), F.lit("noise").alias("template_id")))
    return out


def document_windows(circulars: DataFrame, others: DataFrame, width: int = 1200) -> DataFrame:
    """Training windows: (circular_id, window_no, text, is_circular, family) of positives and negatives."""
    yes = T.windows(circulars, width=width, training=True).join(circulars.select("circular_id", "family"), "circular_id").withColumn("is_circular", F.lit(1))
    no = T.windows(others, width=width, training=True).withColumn("family", F.lit(None).cast("string")).withColumn("is_circular", F.lit(0))
    return yes.unionByName(no)


def expand_templates(templates: DataFrame, slots: dict[str, Sequence[str]], seeds: int) -> DataFrame:
    """Each template (template_id, text) filled ``seeds`` times; a slot's filler is chosen by a hash of seed and slot."""
    rows = templates.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    out = F.col("text")
    for name, fillers in slots.items():
        pick = F.get(F.array(*[F.lit(f) for f in fillers]), F.pmod(F.xxhash64("template_id", "seed", F.lit(name)), F.lit(len(fillers))).cast("int"))
        out = F.replace(out, F.lit("{" + name + "}"), pick)
    return rows.withColumn("text", out)


def leak_free_split(rows: DataFrame, seed: int = 42, percent: int = 30) -> DataFrame:
    """Add held_out: positives are split by template, negatives by document, so no group is on both sides."""
    group = F.when(F.col("is_obligation") == 1, F.concat(F.lit("t:"), F.coalesce("template_id", F.lit("")))).otherwise(F.concat(F.lit("d:"), F.coalesce("doc_id", F.lit(""))))
    return rows.withColumn("held_out", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(100)) < percent)


@dataclass
class TermSpace:
    """A fitted vocabulary: (term, index, df, n) as a table, and its size."""

    terms: DataFrame
    size: int
    longest: int
    characters: bool
    dense: bool


def fit_terms(texts: DataFrame, text: str = "text", key: str = "id", longest: int = 3, characters: bool = True, dense: bool = False, min_df: int = 2, most: int = 60_000) -> TermSpace:
    """The ``most`` most frequent terms with ``min_df`` texts and more: words, and characters inside words."""
    counts = _counts(texts, text, key, longest, characters)
    kept = S.document_frequencies(counts).filter(F.col("df") >= min_df).orderBy(F.desc("df"), "term").limit(most)
    # the vocabulary is bounded by ``most``, so one task may number it
    numbered = materialize(kept.withColumn("index", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1), "vocabulary")
    return TermSpace(numbered, numbered.count(), longest, characters, dense)


def _counts(texts: DataFrame, text: str, key: str, longest: int, characters: bool) -> DataFrame:
    mark = lambda a, p: F.transform(a, lambda t: F.concat(F.lit(p), t))
    terms = mark(S.word_terms(F.col(text), longest, ()), "word__")
    if characters:
        terms = F.concat(terms, mark(S.char_terms(F.col(text)), "char__"))
    return S.term_counts(texts, terms, key)


def vectorize(texts: DataFrame, space: TermSpace, text: str = "text", key: str = "id") -> DataFrame:
    """The texts with a sparse vector ``features``: sublinear TF-IDF, each kind of term of unit norm, then the dense features."""
    counts = _counts(texts, text, key, space.longest, space.characters).join(F.broadcast(space.terms), "term")
    raw = counts.withColumn("kind", F.substring("term", 1, 4)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = Window.partitionBy("id", "kind")
    rows = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm)))
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "w"))).alias("pairs"))
    base = texts.join(gathered.withColumnRenamed("id", "_id"), F.col(key) == F.col("_id"), "left").drop("_id")
    dense = X.modality_features(F.coalesce(F.col(text), F.lit("")))
    extra = F.array(*[dense[n].cast("double") for n in DENSE]) if space.dense else F.array().cast("array<double>")
    pairs = F.coalesce("pairs", F.array().cast("array<struct<index:int,w:double>>"))
    more = F.transform(extra, lambda v, i: F.struct((i + space.size).alias("index"), v.alias("w")))
    whole = F.filter(F.concat(pairs, more), lambda p: p["w"] != 0)
    size = space.size + (len(DENSE) if space.dense else 0)
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.transform(whole, lambda p: p["index"]).alias("indices"), F.transform(whole, lambda p: p["w"]).alias("values"))
    return with_vectors(base.withColumn("features", parts).drop("pairs"))


def with_vectors(rows: DataFrame) -> DataFrame:
    """The rows with ``features`` as a vector: a struct of a vector's parts, written once and read as the vector type."""
    path = scratch_path(rows.sparkSession, "vectors")
    rows.write.option("compression", "zstd").parquet(path)
    schema = StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in rows.schema.fields])
    return rows.sparkSession.read.schema(schema).parquet(path)


def save_bundle(path: str, space: TermSpace, heads: dict[str, LogisticRegressionModel], labels: dict[str, list[str]] | None = None) -> None:
    """Write the vocabulary, the heads and their labels below ``path``."""
    space.terms.write.mode("overwrite").parquet(f"{path}/terms")
    facts = [(k, F.lit(v)) for k, v in (("size", space.size), ("longest", space.longest), ("characters", space.characters), ("dense", space.dense))]
    space.terms.sparkSession.range(1).select(*[v.alias(k) for k, v in facts]).write.mode("overwrite").parquet(f"{path}/space")
    rows = [(n, (labels or {}).get(n, [])) for n in heads]
    space.terms.sparkSession.createDataFrame(rows, "head string, labels array<string>").write.mode("overwrite").parquet(f"{path}/heads")
    for name, model in heads.items():
        model.write().overwrite().save(f"{path}/models/{name}")


def load_bundle(spark: SparkSession, path: str) -> tuple[TermSpace, dict[str, LogisticRegressionModel], dict[str, list[str]]]:
    """What ``save_bundle`` wrote, after one throw-away prediction with each head."""
    s = spark.read.parquet(f"{path}/space").first()
    space = TermSpace(spark.read.parquet(f"{path}/terms"), s["size"], s["longest"], s["characters"], s["dense"])
    rows = spark.read.parquet(f"{path}/heads").collect()
    heads = {r["head"]: LogisticRegressionModel.load(f"{path}/models/{r['head']}") for r in rows}
    for model in heads.values():
        model.predict(SparseVector(model.numFeatures, {}))
    return space, heads, {r["head"]: list(r["labels"]) for r in rows}


def balanced(rows: DataFrame, label: str = "label") -> DataFrame:
    """Add weight: rows of each label weigh as much in sum as those of any other."""
    by = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    totals = by.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return rows.join(F.broadcast(by), label).crossJoin(F.broadcast(totals)).withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def fit_head(rows: DataFrame, label: str = "label", strength: float = 4.0, max_iter: int = 100) -> LogisticRegressionModel:
    """Logistic regression with balanced weights and the penalty 1 / (strength x rows); labels are numbers from 0."""
    weighted = balanced(rows, label)
    n = rows.count()
    return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", standardization=False, regParam=1.0 / (strength * max(n, 1)), maxIter=max_iter).fit(weighted)


def fit_labels(rows: DataFrame, label: str) -> tuple[LogisticRegressionModel, list[str]]:
    """A head for text labels, and the labels in the order of their numbers."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    return fit_head(index.transform(rows), "_label"), index.labels


def fit_one_vs_rest(rows: DataFrame, labels: Sequence[str], column: str) -> dict[str, LogisticRegressionModel]:
    """A binary head per label of an array column; labels that all rows or none have are left out."""
    out = {}
    n = rows.count()
    for name in labels:
        marked = rows.withColumn("label", F.array_contains(column, name).cast("double"))
        if 0 < marked.filter("label = 1").count() < n:
            out[name] = fit_head(marked)
    return out


def probability(model: LogisticRegressionModel, rows: DataFrame, name: str) -> DataFrame:
    """Add the probability of label 1, rounded to 4 places."""
    out = model.transform(rows)
    return out.withColumn(name, F.bround(vector_to_array("probability").getItem(1), 4)).drop("probability", "rawPrediction", "prediction")


def best_label(model: LogisticRegressionModel, labels: Sequence[str], rows: DataFrame, name: str) -> DataFrame:
    """Add the likeliest label and its probability."""
    names = F.array(*[F.lit(x) for x in labels])
    out = model.transform(rows).withColumn("_p", vector_to_array("probability"))
    at = F.array_position("_p", F.array_max("_p")).cast("int") - 1
    return out.withColumn(name, F.get(names, at)).withColumn(f"{name}_confidence", F.bround(F.array_max("_p"), 4)).drop("_p", "probability", "rawPrediction", "prediction")


def classify_sentences(rows: DataFrame, detector: LogisticRegressionModel, heads: dict[str, tuple[LogisticRegressionModel, list[str]]], threshold: float = 0.55) -> DataFrame:
    """Scored sentences; the detail heads see only those at the threshold (others have nulls)."""
    scored = probability(detector, rows, "obligation_probability").withColumn("is_obligation", F.col("obligation_probability") >= threshold)
    hits = scored.filter("is_obligation")
    for name, (model, labels) in heads.items():
        hits = best_label(model, labels, hits, name)
    return hits.unionByName(scored.filter("not is_obligation"), allowMissingColumns=True)


def explain(rows: DataFrame, model: LogisticRegressionModel, space: TermSpace, key: str = "id", k: int = 6) -> DataFrame:
    """(key, feature, contribution, direction, rank): weight times value, largest first; characters take at most half.

    Of several classes the likeliest one's weights count.
    """
    spark = rows.sparkSession
    matrix = model.coefficientMatrix.toArray()
    table = spark.createDataFrame([(c, i, float(v)) for c in range(matrix.shape[0]) for i, v in enumerate(matrix[c]) if v], "cls int, index int, weight double")
    names = space.terms.select("index", "term").unionByName(spark.createDataFrame([(space.size + i, f"modality__{n}") for i, n in enumerate(DENSE)], "index int, term string"))
    scored = model.transform(rows).withColumn("cls", F.when(F.lit(matrix.shape[0] > 1), F.col("prediction").cast("int")).otherwise(F.lit(0)))
    parts = scored.select(key, "cls", F.posexplode(vector_to_array("features")).alias("index", "value")).filter("value <> 0")
    return explain_parts(parts.join(F.broadcast(table), ["cls", "index"]).join(F.broadcast(names), "index").select(key, "term", "value", "weight"), key, k)


def explain_terms(values: DataFrame, coefficients: DataFrame, key: str = "id", k: int = 6) -> DataFrame:
    """``explain_parts`` of texts in long form (key, term, value) and a sparse table of coefficients (term, weight); terms without a weight tell nothing."""
    return explain_parts(values.join(coefficients.filter("weight <> 0"), "term").select(key, "term", "value", "weight"), key, k)


def explain_parts(parts: DataFrame, key: str = "id", k: int = 6) -> DataFrame:
    """(key, feature, contribution, direction, rank) of rows (key, term, value, weight): the k largest products a key, where
    character terms take at most half of the places and are looked for among the 3 k largest. What differs beyond the ninth place is a tie, broken by term."""
    found = parts.withColumn("contribution", F.col("value") * F.col("weight"))
    by_size = Window.partitionBy(key).orderBy(F.desc(F.round(F.abs("contribution"), 9)), "term")
    wide = found.withColumn("_n", F.row_number().over(by_size)).filter(F.col("_n") <= 3 * k)
    words_first = Window.partitionBy(key).orderBy("_n")
    character = F.startswith("term", F.lit("char__"))
    before = F.sum(F.when(character, 0).otherwise(1)).over(words_first)
    chars = F.sum(F.when(character, 1).otherwise(0)).over(words_first)
    kept = wide.withColumn("_before", before).withColumn("_chars", chars).filter(~character | (F.col("_before") + F.col("_chars") <= k // 2))
    rank = F.row_number().over(words_first)
    out = kept.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(key, F.trim(F.substring_index("term", "__", -1)).alias("feature"), F.bround("contribution", 4).alias("contribution"), F.when(F.col("contribution") > 0, "supports").otherwise("opposes").alias("direction"), "rank")


def recognise(window_rows: DataFrame, nearest: DataFrame, key: str = "circular_id", known_at: float = 0.60, sure_at: float = 0.55) -> DataFrame:
    """Per document, from its windows (circular_probability, family_scores map) and nearest family (id, similarity).

    Mean probabilities, the likeliest family, novelty, and the verdict text.
    """
    families = window_rows.select(key, F.explode("family_scores").alias("family", "p")).groupBy(key, "family").agg(F.avg("p").alias("p"))
    best = families.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("p"), "family"))).filter("_n = 1").select(key, "family", F.bround("p", 4).alias("family_confidence"))
    base = window_rows.groupBy(key).agg(F.bround(F.avg("circular_probability"), 4).alias("circular_confidence"), F.count(F.lit(1)).alias("windows_analysed"))
    rows = base.join(best, key, "left").join(nearest.select(F.col("id").alias(key), "similarity"), key, "left")
    sim = F.coalesce("similarity", F.lit(0.0))
    rows = rows.withColumn("novelty", F.bround(1 - sim, 4)).withColumn("is_novel_topic", (sim < known_at) | (F.coalesce("family_confidence", F.lit(0.0)) < sure_at)).withColumn("is_circular", F.col("circular_confidence") >= 0.5)
    name = F.replace("family", F.lit("_"), F.lit(" "))
    told = F.when(F.col("is_novel_topic"), "new topic, nearest family: ").otherwise("family: ")
    verdict = F.when(F.col("is_circular"), F.concat(told, name)).otherwise(L.NOT_RECOGNISED)
    return rows.withColumn("verdict", verdict).drop("similarity")


def rule_scores(units: DataFrame) -> DataFrame:
    """A scorer without a trained model: probability from modality (0.9 binding, 0.4 discretionary, 0.1 other)."""

    def score(low: Column) -> Column:
        f = X.modality_features(F.col("sentence"), low)
        return F.when((f["has_deontic"] == 1) | (f["has_prohibition"] == 1), 0.9).when(f["has_discretion"] == 1, 0.4).otherwise(0.1)

    return units.withColumn("obligation_probability", let(folded(F.col("sentence")), score))


def extract_obligations(docs: DataFrame, scorer=rule_scores, threshold: float = 0.55, requested: Sequence[str] = ()) -> DataFrame:  # noqa: ANN001
    """Documents (circular_id, title, document_text) to obligation rows.

    ``scorer`` adds obligation_probability to unit rows and keeps their columns; it may add severity, severity_confidence, deadline_type
    and intermediary_types of its own under model_* names.
    """
    # dealt once, as the numbers need it; a number of parts is given, as a few large ones would leave cores idle: the work on a text is far more than its size
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("circular_id", "title", "document_text").repartition(parts, "circular_id")
    base = T.units(docs, carry=["title"]).filter(~T.is_boilerplate(F.col("sentence")))
    rows = scorer(base)
    for name, kind in (("model_severity", "string"), ("model_severity_confidence", "double"), ("model_deadline_type", "string"), ("model_types", "array<string>")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    hits = rows.filter(F.col("obligation_probability") >= threshold)
    s = F.col("sentence")
    asked = F.array(*[F.lit(r) for r in requested]).cast("array<string>")
    low = F.col("_low")
    first = hits.withColumn("_low", folded(s)).withColumns({"_d": X.deadline(s, low), "_action": X.action(s, low), "_evidence": X.evidence(s)})
    first = first.withColumn("deadline_type", X.adopt_type(F.col("_d.deadline"), F.col("_d.deadline_type"), F.col("model_deadline_type")))
    first = first.withColumn("_s", X.severity(s, F.col("deadline_type"), F.col("model_severity"), F.col("model_severity_confidence"), low))
    number = F.row_number().over(Window.partitionBy("circular_id").orderBy("order")) - 1
    why = F.format_string(L.RATIONALE, "obligation_probability", "section", F.col("_s.severity"), F.col("_s.basis"))
    return first.select(
        F.concat_ws("_", "circular_id", F.lit("obl"), number.cast("string")).alias("obligation_id"),
        "circular_id",
        "order",
        X.clause_reference(F.col("clause_number"), F.col("section"), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("circular_id").cast("string")), s).alias("clause_reference"),
        X.title(F.col("_action"), s).alias("title"),
        s.alias("description"),
        X.responsible(s, low=low).alias("responsible_party"),
        F.col("_action").alias("required_action"),
        F.col("_d.deadline").alias("deadline"),
        "deadline_type",
        X.applies_to(X.named_types(s), F.col("model_types"), asked).alias("intermediary_types"),
        F.col("_evidence").alias("evidence_requirements"),
        F.lit("red").alias("evidence_status"),
        F.lit("active").alias("status"),
        X.keywords(s).alias("keywords"),
        F.col("_s.severity").alias("severity"),
        why.alias("extraction_rationale"),
        F.bround("obligation_probability", 3).alias("confidence_score"),
        X.mandatory_terms(s).alias("mandatory_keywords"),
        X.checklist(F.col("_evidence")).alias("evidence_checklist"),
    )


def borderline(scored: DataFrame, threshold: float = 0.55, least: float = 0.30, most: int = 15, key: str = "circular_id") -> DataFrame:
    """Rejects near the threshold, per document the ``most`` likeliest, cut at 200 characters."""
    near = scored.filter((F.col("obligation_probability") < threshold) & (F.col("obligation_probability") >= least))
    w = Window.partitionBy(key).orderBy(F.desc("obligation_probability"), "order")
    return near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select(key, F.substring("sentence", 1, 200).alias("text"), F.col("obligation_probability").alias("probability"), "section")
