"""Registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def vocabulary_json(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's definition as JSON text; read once on the driver and broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


@functools.cache
def unigram_pieces(name: str = "piece_bpe_32k.model") -> list[tuple[str, float]]:
    """A public vocabulary's pieces and scores; read once on the driver and broadcast."""
    import public_tokenizers

    from statuta.llm.token_counts import pieces_of

    return pieces_of(public_tokenizers.path(name))


@functools.cache
def control_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """The control pieces of the same vocabulary."""
    import public_tokenizers

    from statuta.llm.token_counts import control_pieces_of

    return control_pieces_of(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary_json(), max_len=4096, end_id=2)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"), scope=400).drop("found")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.simhash import groups

    return groups(table(spark, sf_dir, "documents"), radius=4, size=4, seed=42)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.language_model import score

    return score(table(spark, sf_dir, "documents"), folds=7, held_out=2, deleted=3)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.pii import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.sharding import assign

    out = assign(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.decontamination import digest, scan

    return digest(scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), unigram_pieces(), special=control_pieces())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.quality_model import classify, learn

    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild_every=100, rebuild_most=6)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.toxicity import classify, learn

    docs = table(spark, sf_dir, "documents")
    return classify(docs, learn(docs, table(spark, sf_dir, "labels")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from statuta.llm.centroid_clustering import clusters_with_inertia

    return clusters_with_inertia(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64, seed=1)


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_secret_scans, op3_simhash, op4_lm_scoring, op5_pii, op6_sharding, op7_quality_rules, op8_decontamination, op9_token_counts, op10_quality_classifier, op11_prefix_trie, op12_toxicity, op13_centroid_clustering)
}

ORACLES: dict[str, str] = dict(oracles.ORACLES)
