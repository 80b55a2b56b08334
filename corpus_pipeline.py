"""The corpus pipeline: stages that each call one training-data operator over all that is left.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns
the pieces of packed sequences. Columns besides doc_id and text pass through whatever their names and values are
(n_chars follows a text that is changed); nulls in any column, repeated rows, empty and very long texts and
empty tables have the results that each stage states; an empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text has too few words and goes; repeated rows share their fate."""
    from statuta.llm.quality_rules import filter_by_rules

    return filter_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least id.

    Of repeated rows one stays; null and blank texts are one group; rows without an id stay where no row of their group has one.
    """
    from statuta.llm.simhash import keep_one

    return keep_one(docs, radius=4, size=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, without the benchmark passages that some of them hold.

    A null or empty text stays; repeated rows are judged each on its own.
    """
    from statuta.llm.decontamination import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, coverage=20, remove_spans=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blanked; repeated rows, nulls and texts without secrets stay as they are."""
    from statuta.llm.secret_scan import redact

    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; a null text is the end token alone, repeated rows are packed each on its own."""
    from statuta.llm.packing import pack
    from statuta.llm.queries import vocabulary_json

    # the workers of earlier stages live on, so this stage remembers less than the operator alone
    return pack(docs, vocabulary_json(), max_len=4096, end_id=2, remembered=(24_000_000, 12_000_000))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

#: Token ids and fingerprints are not expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared scratch folder and read again."""
    from statuta.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
