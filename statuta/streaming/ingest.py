"""Streams: document ingestion, audit events, checklist updates, alerts per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statuta.operators.evidence import fold_updates
from statuta.operators.register import upsert
from statuta.sources.buckets import change_buckets, read_buckets, touched_buckets, upsert_buckets
from statuta.sources.writers import SEEN, mark_seen, read_or_empty, replace_table, unseen, write_batch

DOCUMENTS = "detail_url string, circular_id string, title string, circular_type string, date string, document_text string"


def ingest(spark: SparkSession, source: str, register: str, seen: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], register_schema: str, most_files: int = 5, least_chars: int = 100, every: str | None = None, dry_run: bool = False, buckets: int | None = None) -> StreamingQuery:
    """Take up new document files: drop seen and too short ones, extract, upsert the register, mark as seen.

    A batch that runs twice leaves the same register, since rows are keyed; a document is marked only after its
    rows are written, so failures are retried; a dry run marks nothing. ``every`` is the pause between runs, such as '6 hours'.
    With ``buckets``, register and registry are tables of so many hash buckets (``sources.buckets``), and a batch reads and writes
    only those of its own keys; else they are plain tables that are written anew in each batch.
    """

    def batch(docs: DataFrame, _: int) -> None:
        session = docs.sparkSession
        if buckets:
            known = read_buckets(session, seen, SEEN, touched_buckets(session, seen, docs, "detail_url", buckets)[0])
        else:
            known = read_or_empty(session, seen, SEEN)
        new = unseen(docs.filter(F.length("document_text") >= least_chars).dropDuplicates(["detail_url"]), known).persist()
        try:
            if new.isEmpty():
                return
            if not dry_run:
                if buckets:
                    upsert_buckets(session, register, extract(new), register_schema, buckets=buckets)
                else:
                    replace_table(upsert(read_or_empty(session, register, register_schema), extract(new)), register)
                done = new.select("detail_url", "title", "date", "circular_type", "circular_id", F.lit(None).cast("string").alias("pdf_url"), F.current_timestamp().alias("processed_at"), F.lit(False).alias("dry_run"))
                if buckets:
                    change_buckets(session, seen, done, SEEN, "detail_url", mark_seen, buckets)
                else:
                    replace_table(mark_seen(known, done), seen)
        finally:
            new.unpersist()

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", most_files).json(source)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def audit_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Audit events without repeats of event_id within the watermark; timestamp is event time."""
    return events.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"])


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table of one folder a batch, so that a batch that is tried again leaves no row twice."""
    return rows.writeStream.foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, at: str = "timestamp", kind: str = "event_type") -> DataFrame:
    """Events per day and type, for batches and streams alike."""
    return events.groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def checklist_batch(register_path: str, updates_path: str, register_schema: str, buckets: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: add updates, fold those of the obligations that they name, set their evidence status.

    A batch that runs again replaces its own updates and leaves the same register. With ``buckets``, the register is a table of
    hash buckets and only those of the named obligations are written.
    """

    def with_state(register: DataFrame, state: DataFrame) -> DataFrame:
        return register.join(state, "obligation_id", "left").withColumn("evidence_status", F.coalesce("_s", "evidence_status")).drop("_s")

    def batch(updates: DataFrame, batch_id: int) -> None:
        session = updates.sparkSession
        write_batch(updates, updates_path, batch_id)
        named = updates.select("obligation_id").distinct()
        state = fold_updates(session.read.parquet(updates_path).drop("batch").join(named, "obligation_id", "left_semi")).select("obligation_id", F.col("evidence_status").alias("_s"))
        if buckets:
            change_buckets(session, register_path, state, register_schema, "obligation_id", with_state, buckets)
        else:
            replace_table(with_state(read_or_empty(session, register_path, register_schema), state), register_path)

    return batch
