"""Sinks: tables of the graph, logs, registries, exports. Rewrites go through a staging folder and a swap."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from statuta.functions.fields import url_hash


def read_or_empty(spark: SparkSession, path: str, schema: t.StructType | str) -> DataFrame:
    """A Parquet table, or an empty one where there is none yet; a swap that broke off is brought to its end first."""
    try:
        return spark.read.schema(schema).parquet(path) if recover(spark, path) else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def recover(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``, after a swap that broke off was brought to its end.

    The new files are whole once their folder holds Spark's success mark. With the old table moved aside and nothing in its
    place, whole new files take the place; else the old ones come back.
    """
    fs, target = _fs(spark, path)
    (_, staging), (_, old), (_, whole) = (_fs(spark, f"{path}{end}") for end in (".staging", ".old", ".staging/_SUCCESS"))
    if not fs.exists(target) and fs.exists(old):
        fs.rename(staging if fs.exists(whole) else old, target)
    return fs.exists(target)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap; whatever step a crash comes after, ``recover`` finds a whole table."""
    spark = df.sparkSession
    recover(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.staging")
    (fs, target), (_, staging), (_, old) = (_fs(spark, f"{path}{end}") for end in ("", ".staging", ".old"))
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(staging, target)
    fs.delete(old, True)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    replace_table(nodes, f"{path}/nodes")
    replace_table(edges, f"{path}/edges")


def load_graph(spark: SparkSession, path: str, node_schema: str, edge_schema: str = "src string, dst string, edge_type string, weight double") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; empty where nothing was saved."""
    return read_or_empty(spark, f"{path}/nodes", node_schema), read_or_empty(spark, f"{path}/edges", edge_schema)


AUDIT = "timestamp timestamp, event_type string, circular_id string, actor string, status string, details string, error string"
EVIDENCE = "obligation_id string, filename string, saved_path string, uploaded_by string, uploaded_at timestamp, match_score double, evidence_status string, matched array<string>, unmatched array<string>, method string"
SEEN = "detail_url string, title string, date string, circular_type string, circular_id string, pdf_url string, processed_at timestamp, dry_run boolean"
PASSAGES = "circular_id string, passage_id string, text string, section string, kind string, obligation_id string, indexed_at timestamp"


def append(df: DataFrame, path: str) -> None:
    """Append log, metric, evidence or passage rows."""
    df.write.mode("append").parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a stream's batch as a folder of its own below ``path``; a batch that runs again replaces its folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:020d}")


def run_metrics(runs: DataFrame) -> DataFrame:
    """Runs (run_id, circular_id, chars, obligations, seconds) with pages, obligations per page and a summary text."""
    pages = page_estimate(F.col("chars"))
    return runs.select("*", pages.alias("pages"), F.bround(F.col("obligations") / pages, 2).alias("obligations_per_page"), run_summary_text(F.col("chars"), F.col("obligations"), F.col("seconds")).alias("summary"))


def audit_trail(log: DataFrame, circular_id: str | None = None, status: str | None = None) -> DataFrame:
    rows = log if circular_id is None else log.filter(F.col("circular_id") == circular_id)
    return rows if status is None else rows.filter(F.col("status") == status)


def audit_summary(log: DataFrame) -> DataFrame:
    """One row: events, distinct circulars completed, failures, the last event."""
    return log.agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct(F.when((F.col("event_type") == "pipeline_completed"), F.col("circular_id"))).alias("circulars_completed"),
        F.count_if(F.col("status") == "failure").alias("failures"),
        F.max_by("event_type", F.struct("timestamp", "event_type")).alias("last_event"),
    )


def latest(rows: DataFrame, *order: str, by: str | None = None) -> DataFrame:
    """The last row by ``order``, of each ``by`` where given."""
    whole = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return (rows.groupBy(by).agg(whole) if by else rows.agg(whole)).filter("r is not null").select("r.*")


def tail(log: DataFrame, n: int = 10, order: str = "timestamp") -> DataFrame:
    return log.orderBy(F.desc(order)).limit(n)


def mark_seen(seen: DataFrame, processed: DataFrame) -> DataFrame:
    """The registry with processed entries; an entry that is there already is replaced; dry runs are never kept."""
    new = processed.filter(~F.coalesce("dry_run", F.lit(False)))
    return seen.join(new.select("detail_url"), "detail_url", "left_anti").unionByName(new)


def remove_seen(seen: DataFrame, hashed: str) -> DataFrame:
    """The registry without the entry of that URL hash, so that it is fetched again."""
    return seen.filter(url_hash(F.col("detail_url")) != hashed)


def list_seen(seen: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return seen.withColumn("url_hash", url_hash(F.col("detail_url"))).orderBy(F.desc("processed_at"), "detail_url").offset(offset).limit(limit)


def unseen(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries whose URL the registry does not have."""
    return entries.join(seen.select("detail_url"), "detail_url", "left_anti")


def list_indexed(passages: DataFrame) -> DataFrame:
    return passages.groupBy("circular_id").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("text")).alias("characters"), F.max("indexed_at").alias("indexed_at")).orderBy(F.desc("indexed_at"), "circular_id")


def export_with_envelope(rows: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """Rows as JSON lines below ``path``/rows, and one line of metadata with their number below ``path``/metadata."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    facts = [F.lit(v).alias(k) for k, v in metadata.items()]
    rows.sparkSession.read.schema(rows.schema).json(f"{path}/rows").agg(F.count(F.lit(1)).alias("total")).select("total", *facts).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def ground_truth(specs: DataFrame) -> DataFrame:
    """Specs (sections of clauses) as one row per document with all its clauses."""
    return specs.select("circular_id", "family", F.flatten(F.transform("sections", lambda s: s["clauses"])).alias("clauses"))


def ingestion_summary(outcomes: DataFrame) -> DataFrame:
    """One row: ingested, errors, status text."""
    rows = outcomes.agg(F.count_if(F.col("outcome") == "ingested").alias("ingested"), F.count_if(F.col("outcome") == "error").alias("errors"))
    status = F.when(F.col("errors") == 0, "success").when(F.col("ingested") > 0, "partial").otherwise("failed")
    return rows.withColumn("status", status)


def run_summary_text(chars: Column, obligations: Column, seconds: Column) -> Column:
    return F.format_string("%d obligations from %d characters in %.1f s", obligations, chars, seconds)


def page_estimate(chars: Column) -> Column:
    """Pages of 3000 characters, at least one."""
    return F.greatest(F.lit(1), F.floor(chars / 3000)).cast("int")


def save_model_card(spark: SparkSession, card: dict[str, str], path: str) -> None:
    replace_table(spark.createDataFrame([tuple(card.values())], ", ".join(f"{k} string" for k in card)), path)
