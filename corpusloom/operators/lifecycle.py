"""Claims, deletions, retries and job states, as table-to-table jobs that give the same result when run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Codes of errors that another try can't mend.
PERMANENT = ("EMPTY_DOCUMENT", "UNSUPPORTED_DOCUMENT_TYPE", "DOCUMENT_PARSE_FAILED", "EMBEDDING_INVALID_RESPONSE", "INVALID_CHUNK_SETTINGS")
# Progress at the start of each stage.
STAGE_PROGRESS = {"queued": 0, "parsing": 10, "chunking": 35, "embedding": 55, "completed": 100}


def classify_error(code: Column) -> Column:
    """"permanent" or "transient"; null for no error."""
    return F.when(code.isNotNull(), F.when(code.isin(*PERMANENT), "permanent").otherwise("transient"))


def error_message(message: Column) -> Column:
    return F.substring(message, 1, 1000)


def validate_messages(df: DataFrame) -> DataFrame:
    """Queue messages + error_code: a missing type, or ids of a delete message that aren't UUIDs. Unknown types pass and are routed nowhere."""
    ok = lambda c: F.coalesce(F.col(c).rlike(UUID), F.lit(False))
    bad = (
        F.when(F.coalesce(F.trim("type"), F.lit("")) == "", "INVALID_MESSAGE")
        .when((F.col("type") == "document.delete") & ~(ok("owner_id") & ok("document_id")), "INVALID_MESSAGE")
        .when((F.col("type") == "knowledge_base.delete") & ~(ok("owner_id") & ok("knowledge_base_id")), "INVALID_MESSAGE")
    )
    return df.withColumn("error_code", bad)


def claim_jobs(messages: DataFrame, jobs: DataFrame, docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """(job_id, index_version, outcome) for each distinct index message: claimed, duplicate or not_claimable.

    A message must name a job of its document, version and owner, none deleted; the job must be pending and the document queued.
    """
    asked = messages.dropDuplicates(["job_id", "index_version"])
    j = jobs.select(F.col("id").alias("job_id"), F.col("document_id").alias("j_doc"), F.col("index_version").alias("j_version"), F.col("status").alias("j_status"))
    d = docs.select(F.col("id").alias("j_doc"), F.col("index_version").alias("d_version"), F.col("status").alias("d_status"), F.col("deleted_at").alias("d_deleted"), F.col("knowledge_base_id").alias("kb"))
    k = kbs.select(F.col("id").alias("kb"), F.col("owner_id").alias("k_owner"), F.col("deleted_at").alias("k_deleted"))
    df = asked.join(j, "job_id", "left").join(d, "j_doc", "left").join(k, "kb", "left")
    c = F.col
    matches = (c("j_doc") == c("document_id")) & (c("j_version") == c("index_version")) & (c("d_version") == c("index_version")) & (c("k_owner") == c("owner_id")) & c("d_deleted").isNull() & c("k_deleted").isNull()
    outcome = F.when(F.coalesce(matches, F.lit(False)), F.when((c("j_status") == "pending") & (c("d_status") == "queued"), "claimed").otherwise("duplicate")).otherwise("not_claimable")
    return df.select("job_id", "document_id", "index_version", outcome.alias("outcome"))


def apply_claims(jobs: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """jobs with the claimed ones running: stage parsing, progress 10, one more attempt."""
    mark = claims.filter("outcome = 'claimed'").select(F.col("job_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    df = jobs.join(mark, "id", "left")
    put = lambda c, v: F.when(F.col("_hit"), v).otherwise(F.col(c))
    df = df.withColumns({"status": put("status", F.lit("running")), "stage": put("stage", F.lit("parsing")), "progress": put("progress", F.lit(10)), "attempts": put("attempts", F.col("attempts") + 1), "started_at": put("started_at", now)})
    return df.select(*jobs.columns)


def _cascade(keys: DataFrame, docs: DataFrame, chunks: DataFrame, jobs: DataFrame, now: Column, code: str) -> dict[str, DataFrame]:
    """What happens to the documents in keys (id)."""
    keys = keys.distinct()
    mark = keys.withColumn("_hit", F.lit(True))
    put = lambda c, v: F.when(F.col("_hit"), v).otherwise(F.col(c))
    left = chunks.join(keys, chunks.document_id == keys.id, "left_anti")
    d = docs.join(mark, "id", "left").withColumns({"status": put("status", F.lit("deleting")), "chunk_count": put("chunk_count", F.lit(0)), "deleted_at": put("deleted_at", F.coalesce(F.col("deleted_at"), now))})
    j = jobs.join(mark.withColumnRenamed("id", "document_id"), "document_id", "left")
    hit = F.col("_hit") & F.col("status").isin("pending", "running")
    end = lambda c, v: F.when(hit, v).otherwise(F.col(c))
    j = j.select(*(c for c in jobs.columns if c not in ("status", "stage", "error_code")), end("status", F.lit("failed")).alias("status"), end("stage", F.lit("deleted")).alias("stage"), end("error_code", F.lit(code)).alias("error_code"))
    return {"documents": d.select(*docs.columns), "chunks": left, "jobs": j.select(*jobs.columns)}


def deleted_documents(messages: DataFrame, docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """(id) of documents that valid document.delete messages of their owners name."""
    asked = messages.filter("type = 'document.delete'").select("document_id", "owner_id").distinct()
    owned = docs.select("id", "knowledge_base_id").join(kbs.select(F.col("id").alias("knowledge_base_id"), "owner_id"), "knowledge_base_id")
    return owned.join(asked, (owned.id == asked.document_id) & (owned.owner_id == asked.owner_id), "left_semi").select("id")


def apply_document_deletes(messages: DataFrame, docs: DataFrame, kbs: DataFrame, chunks: DataFrame, jobs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Tables after the deletes: no chunks, open jobs failed, documents deleting. A wrong owner changes nothing; a second run changes nothing."""
    return _cascade(deleted_documents(messages, docs, kbs), docs, chunks, jobs, now, "DOCUMENT_DELETED")


def deleted_knowledge_bases(messages: DataFrame, kbs: DataFrame) -> DataFrame:
    """(id) of knowledge bases that valid knowledge_base.delete messages of their owners name."""
    asked = messages.filter("type = 'knowledge_base.delete'").select(F.col("knowledge_base_id").alias("id"), "owner_id").distinct()
    return kbs.join(asked, ["id", "owner_id"], "left_semi").select("id")


def apply_kb_deletes(messages: DataFrame, docs: DataFrame, kbs: DataFrame, chunks: DataFrame, jobs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """As apply_document_deletes for whole knowledge bases, + the knowledge bases with deleted_at."""
    gone = deleted_knowledge_bases(messages, kbs)
    keys = docs.join(gone.withColumnRenamed("id", "knowledge_base_id"), "knowledge_base_id", "left_semi").select("id")
    out = _cascade(keys, docs, chunks, jobs, now, "KNOWLEDGE_BASE_DELETED")
    k = kbs.join(gone.withColumn("_hit", F.lit(True)), "id", "left").withColumn("deleted_at", F.when(F.col("_hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at")))
    return out | {"knowledge_bases": k.select(*kbs.columns)}


def deletion_object_keys(docs: DataFrame, document_ids: DataFrame | None = None, kb_ids: DataFrame | None = None) -> DataFrame:
    """(id, object_key) to remove, by document or by knowledge base, ordered by id."""
    if document_ids is not None:
        docs = docs.join(document_ids.select("id").distinct(), "id", "left_semi")
    if kb_ids is not None:
        docs = docs.join(kb_ids.select(F.col("id").alias("knowledge_base_id")).distinct(), "knowledge_base_id", "left_semi")
    return docs.select("id", "object_key").orderBy("id")


def documents_with_latest_job(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """docs + job_id, job_status, job_created_at of each document's newest job (ties: the largest id). One partial aggregation, no sort of all jobs."""
    latest = jobs.groupBy("document_id").agg(F.max(F.struct("created_at", "id", "status")).alias("j"))
    return docs.join(latest, docs.id == latest.document_id, "left").select(docs["*"], F.col("j.id").alias("job_id"), F.col("j.status").alias("job_status"), F.col("j.created_at").alias("job_created_at"))


def document_outcomes(docs: DataFrame, chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """(document_id, chunk_count, status, error_code, retryable): ready, or failed with an error or without chunks."""
    n = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    e = errors.groupBy("document_id").agg(F.min("error_code").alias("error_code"))
    df = docs.select("document_id").join(n, "document_id", "left").join(e, "document_id", "left")
    failed = F.col("error_code").isNotNull() | F.col("chunk_count").isNull()
    return df.select("document_id", F.when(failed, 0).otherwise(F.col("chunk_count")).alias("chunk_count"), F.when(failed, "failed").otherwise("ready").alias("status"), "error_code", (classify_error(F.col("error_code")) == "transient").alias("retryable"))


def prepare_retries(docs: DataFrame, jobs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """(id, retryable, new_document_status, new_job_status, new_progress) for the asked documents: only a failed document with a failed job at its version goes back to the queue."""
    j = jobs.select("document_id", "index_version", F.col("status").alias("job_status"))
    df = docs.join(doc_ids.select("id").distinct(), "id", "left_semi").select("id", "index_version", "status").join(j.withColumnRenamed("document_id", "id"), ["id", "index_version"], "left")
    ok = F.coalesce((F.col("status") == "failed") & (F.col("job_status") == "failed"), F.lit(False))
    return df.select("id", ok.alias("retryable"), F.when(ok, "queued").otherwise(F.col("status")).alias("new_document_status"), F.when(ok, "pending").otherwise(F.col("job_status")).alias("new_job_status"), F.when(ok, 0).alias("new_progress"))


def requeue(failed: DataFrame) -> DataFrame:
    """Of failed deletion messages (error_code) those worth another try, without repeats; malformed ones are dropped."""
    return failed.filter((classify_error(F.col("error_code")) == "transient") & (F.col("error_code") != "INVALID_MESSAGE")).dropDuplicates(["type", "document_id", "knowledge_base_id", "owner_id"])


def fold_job_events(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, status, stage, progress, error_code) after events (job_id, index_version, seq, stage, error_code).

    Events count only for running jobs at their own version. The last event decides; a failure keeps the stage that the job had reached.
    """
    live = jobs.filter("status = 'running'").select(F.col("id").alias("job_id"), "index_version", F.col("stage").alias("old_stage"))
    e = events.join(live, ["job_id", "index_version"])
    fold = e.groupBy("job_id", "old_stage").agg(
        F.max_by("error_code", "seq").alias("error_code"),
        F.max_by(F.when(F.col("error_code").isNull(), F.col("stage")), F.when(F.col("error_code").isNull(), F.col("seq"))).alias("stage"),
    )
    progress = F.element_at(F.create_map(*(F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv)), F.col("stage"))
    fold = fold.withColumn("stage", F.coalesce("stage", "old_stage"))
    status = F.when(F.col("error_code").isNotNull(), "failed").when(F.col("stage") == "completed", "succeeded").otherwise("running")
    return fold.select("job_id", status.alias("status"), "stage", progress.alias("progress"), "error_code")
