"""The query that derives fields returns all of them, so that none is left unmade."""

from pyspark.sql import functions as F

from statuta.operators.classify import extract_obligations
from statuta.plans.text_queries import field_extraction


def test_all_derived_fields_are_in_the_result(spark, tmp_path):
    long = "The member shall " + "file the report and keep a copy of it for the record " * 8 + "within 30 days."
    texts = [f"1. DUTIES OF MEMBERS\n1.1 {long}\n1.2 A stockbroker shall submit audit evidence to the Board every quarter.", "No duty is here at all.", ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    named = docs.select(F.col("doc_id").alias("circular_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("document_text"))
    want = {r.obligation_id: r for r in extract_obligations(named, threshold=0.1).collect()}
    found = field_extraction(spark, str(tmp_path))
    got = {r.obligation_id: r for r in found.collect()}
    assert found.columns == extract_obligations(named).columns and set(got) == set(want) and len(got) == 2
    for key, r in got.items():
        w = want[key]
        assert (r.clause_reference, r.description, r.required_action, r.extraction_rationale) == (w.clause_reference, w.description, w.required_action, w.extraction_rationale)
        assert [r.intermediary_types, r.evidence_requirements, r.keywords, r.mandatory_keywords] == ["\n".join(x) for x in (w.intermediary_types, w.evidence_requirements, w.keywords, w.mandatory_keywords)]
    whole = next(r for r in got.values() if r.description.startswith("The member shall"))
    assert whole.description == " ".join(long.split()) and len(whole.description) > 400 and whole.clause_reference.startswith("Clause 1.1")
