"""Structured Streaming jobs.

A batch may fail at any step and run again.  Each step is therefore either a write that its table
knows by the stream and batch number, or one that gives the same when done twice: claims are written to
a ledger first and taken up again, chunks, outcomes, retries and counters are put in place a
whole state at a time, and jobs are marked only while they are still pending.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import index_corpus
from ..operators.lifecycle import apply_claims, apply_document_deletes, apply_kb_deletes, claim_jobs, deleted_documents, deleted_knowledge_bases, deletion_object_keys
from ..sources.checkpoints import checkpointed
from ..sources.io import chunk_table, drop_chunks, read_messages, write_chunks
from ..sources.snapshots import SnapshotTable
from .ledger import ClaimLedger, RetryTable, is_transient, with_message_key


@dataclass
class IndexTables:
    """Where an index stream reads and writes: callables give the tables as they are at each batch."""

    jobs: Callable[[SparkSession], DataFrame]
    documents: Callable[[SparkSession], DataFrame]
    knowledge_bases: Callable[[SparkSession], DataFrame]
    files: Callable[[SparkSession], DataFrame]  # (document_id, knowledge_base_id, filename, content, index_version)
    chunks_path: str
    outcomes_path: str
    #: Takes the jobs with a batch's claims applied (running, one more attempt), before the batch is indexed; called only with claims that the jobs don't show yet.
    claimed: Callable[[DataFrame], None] | None = None
    #: Removes stored objects (id, object_key) and gives (id, error_code) of documents whose objects it couldn't; those messages are not finished.
    remove_objects: Callable[[DataFrame], DataFrame] | None = None
    #: Takes the tables documents, jobs (and knowledge_bases) after a batch's deletes; called only with deletes.
    deleted: Callable[[dict[str, DataFrame]], None] | None = None
    #: Takes the delete messages (JSON strings, column value) that failed and may be tried again, to put them back into the queue; without it they wait in the retry table.
    requeued: Callable[[DataFrame], None] | None = None
    now: Callable[[], datetime.datetime] = lambda: datetime.datetime.now(datetime.timezone.utc)

    @property
    def ledger_path(self) -> str:
        return self.outcomes_path.rstrip("/") + "-claims"

    @property
    def retries_path(self) -> str:
        return self.outcomes_path.rstrip("/") + "-retries"


def outcome_table(spark: SparkSession, path: str) -> SnapshotTable:
    """Outcomes of documents by (document_id, index_version)."""
    return SnapshotTable(spark, path, ["document_id", "index_version"])


_KINDS = {"document.delete": apply_document_deletes, "knowledge_base.delete": apply_kb_deletes}


def _documents_of(kind: str, messages: DataFrame, docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """(message_key, id): the documents that each message deletes."""
    if kind == "document.delete":
        own = deleted_documents(messages, docs, kbs)
        return own.join(messages.select("message_key", F.col("document_id").alias("id")), "id").select("message_key", "id")
    gone = deleted_knowledge_bases(messages, kbs)
    named = messages.select("message_key", F.col("knowledge_base_id").alias("kb")).join(gone.select(F.col("id").alias("kb")), "kb", "left_semi")
    return docs.select("id", F.col("knowledge_base_id").alias("kb")).join(named, "kb").select("message_key", "id")


def delete_batch(messages: DataFrame, tables: IndexTables) -> DataFrame:
    """Applies valid delete messages (with message_key) and gives those that failed: (message_key, error_code, transient).

    Objects go first; a message whose objects couldn't all be removed is left as it was, the others are finished: chunks go for good, the
    other tables are handed to tables.deleted. A second run changes nothing.
    """
    spark = messages.sparkSession
    failed = spark.createDataFrame([], "message_key string, error_code string, transient boolean")
    for kind, apply in _KINDS.items():
        own = messages.filter(F.col("type") == kind)
        if own.isEmpty():
            continue
        try:
            docs, kbs = tables.documents(spark), tables.knowledge_bases(spark)
            targets = checkpointed(_documents_of(kind, own, docs, kbs))
            if tables.remove_objects is not None:
                kept = checkpointed(tables.remove_objects(deletion_object_keys(docs, document_ids=targets)).select("id", "error_code"))
                bad = checkpointed(targets.join(kept, "id").groupBy("message_key").agg(F.min("error_code").alias("error_code")).withColumn("transient", F.lit(True)))
                failed = failed.unionByName(bad)
                own = own.join(bad, "message_key", "left_anti")
                targets = targets.join(bad, "message_key", "left_anti")
                if own.isEmpty():
                    continue
            drop_chunks(targets.select(F.col("id").alias("document_id")), tables.chunks_path)
            if tables.deleted is not None:
                out = apply(own, docs, kbs, spark.createDataFrame([], "document_id string"), tables.jobs(spark), F.current_timestamp())
                tables.deleted({k: v for k, v in out.items() if k != "chunks"})
        except Exception as error:
            again = is_transient(error)
            failed = failed.unionByName(own.select("message_key", F.lit("DELETION_FAILED" if again else f"DELETION_IMPOSSIBLE: {type(error).__name__}").alias("error_code"), F.lit(again).alias("transient")))
    return failed


def _apply_deletes(valid: DataFrame, tables: IndexTables, writer: str, epoch: int) -> None:
    """The deletes of a batch and those that are due again, each of which fails or succeeds by itself."""
    spark, now = valid.sparkSession, tables.now()
    retries = RetryTable(spark, tables.retries_path)
    if retries.table.done(writer, epoch):
        return
    columns = ["message_key", "type", "document_id", "knowledge_base_id", "owner_id"]
    fresh = with_message_key(valid.filter(F.col("type").isin(*_KINDS))).select(columns)
    asked = checkpointed(fresh.unionByName(retries.due(now).select(columns)).dropDuplicates(["message_key"]))
    if asked.isEmpty():
        return
    failed = checkpointed(delete_batch(asked, tables))
    if tables.requeued is not None:
        back = asked.join(failed.filter("transient"), "message_key", "left_semi").drop("message_key")
        if not back.isEmpty():
            tables.requeued(back.select(F.to_json(F.struct(*back.columns)).alias("value")))
        failed = failed.filter("not transient")
    retries.settle(asked, failed, now, writer, epoch)


def index_batch(batch: DataFrame, tables: IndexTables, epoch: int, dimension: int = 64, writer: str = "index") -> None:
    """Indexes the documents that a batch of messages claims, records their outcomes, then applies its deletes and those due again.

    Deletes come last, so no document that the same batch deletes keeps chunks. Malformed messages and unknown types are dropped.
    `writer` tells streams apart: a batch that runs again has the same writer and epoch.
    """
    spark = batch.sparkSession
    valid = read_messages(batch).filter("error_code is null")
    jobs = tables.jobs(spark)
    attempt = F.coalesce("attempts", F.lit(0)).cast("int") if "attempts" in jobs.columns else F.lit(0)
    asked = claim_jobs(valid.filter("type = 'document.index'"), jobs, tables.documents(spark), tables.knowledge_bases(spark)).filter("outcome = 'claimed'")
    asked = asked.join(jobs.select(F.col("id").alias("job_id"), attempt.alias("attempt")), "job_id")
    claims = checkpointed(ClaimLedger(spark, tables.ledger_path).take(asked, writer, epoch))
    if tables.claimed is not None:
        shown = jobs.filter("status = 'pending'").select(F.col("id").alias("job_id"), attempt.alias("attempt"))
        unseen = checkpointed(claims.join(shown, ["job_id", "attempt"], "left_semi").withColumn("outcome", F.lit("claimed")))
        if not unseen.isEmpty():
            tables.claimed(apply_claims(tables.jobs(spark), unseen, F.current_timestamp()))
    outcomes_at = outcome_table(spark, tables.outcomes_path)
    if not outcomes_at.done(writer, epoch):
        wanted = claims.select("document_id", "index_version").distinct()
        files = tables.files(spark).join(wanted, ["document_id", "index_version"], "left_semi")
        chunks, outcomes = index_corpus(files, dimension=dimension)
        if not chunk_table(spark, tables.chunks_path).done(writer, epoch):
            write_chunks(chunks, tables.chunks_path, writer, epoch)
        outcomes_at.replace(outcomes.join(wanted, "document_id").withColumn("epoch", F.lit(epoch)), writer=writer, batch=epoch)
    _apply_deletes(valid, tables, writer, epoch)


def _stream_id(batch: DataFrame, checkpoint: str) -> str:
    """The id that a stream keeps over restarts from its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint


def start_index_stream(source: DataFrame, tables: IndexTables, checkpoint: str, available_now: bool = False, dimension: int = 64) -> StreamingQuery:
    """Consumes queue messages (value: JSON). Repeated messages change nothing: done jobs aren't pending, the ledger has their claims, and chunks are replaced by key."""
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: index_batch(df, tables, epoch, dimension, _stream_id(df, checkpoint)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def usage_counters(usage: DataFrame) -> DataFrame:
    """Calls, failures, tokens and cost by request type and model."""
    return usage.groupBy("request_type", "model").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") != "succeeded").alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("estimated_cost_usd").alias("cost_usd")
    )


def counter_table(spark: SparkSession, path: str) -> SnapshotTable:
    """Running usage_counters, by counter_key (request type and model as JSON)."""
    return SnapshotTable(spark, path, ["counter_key"])


def count_usage(batch: DataFrame, path: str, epoch: int, writer: str = "usage") -> None:
    """Adds a batch to the counters at a path, once for each batch of a writer. Only the counters that the batch touches are rewritten."""
    added = checkpointed(usage_counters(batch).withColumn("counter_key", F.to_json(F.struct("request_type", "model"))))

    def merged(old: DataFrame | None) -> DataFrame:
        if old is None:
            return added
        both = added.unionByName(old.join(added, "counter_key", "left_semi"))
        sums = {c: F.sum(c).cast(added.schema[c].dataType).alias(c) for c in ("calls", "failed", "prompt_tokens", "cost_usd")}
        return both.groupBy("counter_key", "request_type", "model").agg(*sums.values()).select(added.columns)

    counter_table(batch.sparkSession, path).update(added, merged, writer, epoch)


def start_usage_stream(source: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """usage_counters of a stream in the counter table at `path`: after each batch the counters it touched, in update mode; nothing is kept in the driver."""
    writer = source.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: count_usage(df, path, epoch, _stream_id(df, checkpoint)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rate_limit_stream(events: DataFrame, key: str, ts: str, limit: int, window_s: float, delay: str = "10 minutes") -> DataFrame:
    """(key, ts, hit_no, allowed) of a stream, by the rule of rate_limit_replay.

    State: when the window opened and its hits; it goes once the watermark (`delay` behind the newest event; our choice)
    has passed the window's end. Events of one micro-batch are taken in time order; later ones continue from the state.
    """
    rows = events.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).withWatermark("ts", delay)

    def fold(keys, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        times = pd.concat([p["ts"] for p in pdfs]).sort_values()
        out = []
        for t in times:
            s = t.timestamp()
            if opened is None or s >= opened + window_s:
                opened, n = s, 0
            n += 1
            out.append((keys[0], t, n, n <= limit))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(int((opened + window_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts", "hit_no", "allowed"])

    return rows.groupBy("key").applyInPandasWithState(fold, "key string, ts timestamp, hit_no int, allowed boolean", "opened double, n int", "append", GroupStateTimeout.EventTimeTimeout)
