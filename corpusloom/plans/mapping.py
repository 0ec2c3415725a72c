"""The given tables as tables of a knowledge-base service; the SQL prefixes derive the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    """Documents of the knowledge base `source`: every 17th failed, every 23rd deleted, every 5th at version 2."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"),
        F.col("source").alias("knowledge_base_id"),
        F.concat(F.lit("doc-"), i.cast("string"), F.lit(".txt")).alias("filename"),
        F.when(i % 17 == 0, "failed").when(i % 19 == 0, "queued").otherwise("ready").alias("status"),
        F.when(i % 5 == 0, 2).otherwise(1).alias("index_version"),
        F.when(i % 23 == 0, F.timestamp_seconds(F.lit(1_700_000_000))).alias("deleted_at"),
        F.sha2("text", 256).alias("sha256"),
        F.concat_ws("/", F.lit("raw"), F.concat(F.lit("owner-"), (F.length("source") % 3).cast("string")), "source", i.cast("string")).alias("object_key"),
        F.ceil(F.length("text") / 800).cast("int").alias("chunk_count"),
        "text",
        i.alias("doc_id"),
    )


DOCUMENTS_SQL = """docs as (select doc_id::varchar as id, source as knowledge_base_id, 'doc-' || doc_id || '.txt' as filename,
  case when doc_id % 17 = 0 then 'failed' when doc_id % 19 = 0 then 'queued' else 'ready' end as status, case when doc_id % 5 = 0 then 2 else 1 end as index_version,
  case when doc_id % 23 = 0 then to_timestamp(1700000000) end as deleted_at, sha256(text) as sha256,
  'raw/owner-' || (length(source) % 3) || '/' || source || '/' || doc_id as object_key, ceil(length(text) / 800.0)::int as chunk_count, text, doc_id from documents)"""


def knowledge_bases(spark, sf_dir) -> DataFrame:
    """One for each source, owned by one of three; src13 is deleted."""
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.select(F.col("source").alias("id"), F.concat(F.lit("owner-"), (F.length("source") % 3).cast("string")).alias("owner_id"), F.col("source").alias("name"), F.when(F.col("source") == "src13", F.timestamp_seconds(F.lit(1_700_000_000))).alias("deleted_at"))


KBS_SQL = """kbs as (select distinct source as id, 'owner-' || (length(source) % 3) as owner_id, source as name, case when source = 'src13' then to_timestamp(1700000000) end as deleted_at from documents)"""


def pieces(spark, sf_dir) -> DataFrame:
    """Chunks at every line of a document, at the document's version (every 7th document at an old one)."""
    d = documents(spark, sf_dir)
    e = d.select("id", "doc_id", "knowledge_base_id", "index_version", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "content"))
    return e.select(
        F.concat_ws("-", "id", F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("id").alias("document_id"),
        "knowledge_base_id",
        F.when(F.col("doc_id") % 7 == 0, 0).otherwise(F.col("index_version")).alias("index_version"),
        "chunk_index",
        "content",
    )


PIECES_SQL = """pieces as (select id || '-' || (i - 1) as chunk_id, id as document_id, knowledge_base_id, case when doc_id % 7 = 0 then 0 else index_version end as index_version,
  (i - 1)::int as chunk_index, ls[i] as content from (select *, unnest(range(1, len(ls) + 1)) as i from (select *, string_split(text, chr(10)) as ls from docs)))"""


def jobs(spark, sf_dir) -> DataFrame:
    """Index jobs: one for each event, dealt in turn to all documents."""
    e, n = table(spark, sf_dir, "events"), max(1, table(spark, sf_dir, "documents").count())
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "running").otherwise("succeeded")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        (F.col("event_id") % n).cast("string").alias("document_id"),
        F.when(F.col("event_id") % 5 == 0, 2).otherwise(1).alias("index_version"),
        status.alias("status"),
        F.col("ts").alias("created_at"),
    )


JOBS_SQL = """jobs as (select event_id::varchar as id, (event_id % (select count(*) from documents))::varchar as document_id, case when event_id % 5 = 0 then 2 else 1 end as index_version,
  case event_type when 'error' then 'failed' when 'signup' then 'pending' when 'view' then 'running' else 'succeeded' end as status, ts as created_at from events)"""


def usage(spark, sf_dir) -> DataFrame:
    """The events as calls of providers: error events failed, clicks are chats, views embeddings, the others reranks."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "chat").when(F.col("event_type") == "view", "embedding").otherwise("rerank")
    tokens = F.floor(F.col("value")).cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        kind.alias("request_type"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
        tokens.alias("prompt_tokens"),
        F.when(kind == "chat", F.floor(tokens / 2)).otherwise(0).cast("int").alias("completion_tokens"),
        F.when(kind == "chat", 0).otherwise(1 + F.col("event_id") % 4).cast("int").alias("text_count"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "canceled").when(F.col("event_id") % 3 == 1, "deadline exceeded").otherwise("502")).alias("error"),
        F.col("ts").alias("created_at"),
        "event_type",
    )


USAGE_SQL = """calls as (select *, case when request_type = 'chat' then prompt_tokens // 2 else 0 end as completion_tokens,
  (case when request_type = 'chat' then 0 else 1 + id % 4 end)::int as text_count from (select event_id as id, user_id::varchar as user_id,
  case event_type when 'click' then 'chat' when 'view' then 'embedding' else 'rerank' end as request_type, 'model-' || (user_id % 3) as model,
  floor(value)::int as prompt_tokens, floor(value * 10)::int as latency_ms,
  case when event_type = 'error' then case event_id % 3 when 0 then 'canceled' when 1 then 'deadline exceeded' else '502' end end as error, ts as created_at, event_type from events)),
usage as (select *, (case request_type when 'chat' then prompt_tokens * 0.15::double / 1e6 + completion_tokens * 0.6::double / 1e6 when 'embedding' then prompt_tokens * 0.02::double / 1e6 else prompt_tokens * 0.05::double / 1e6 end)::decimal(18,8) as estimated_cost_usd,
  case error when 'canceled' then 'CANCELED' when 'deadline exceeded' then 'TIMEOUT' when '502' then 'PROVIDER_ERROR' end as error_code, case when error is null then 'succeeded' else 'failed' end as status from calls)"""


def messages(spark, sf_dir) -> DataFrame:
    """Conversations as messages: every 9th failed, system turns kept."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ord"), "role", F.when((F.col("conv_id") + F.col("turn")) % 9 == 8, "failed").otherwise("completed").alias("status"), F.col("text").alias("content"))


MESSAGES_SQL = """messages as (select conv_id as conversation_id, turn as ord, role, case when (conv_id + turn) % 9 = 8 then 'failed' else 'completed' end as status, text as content from conversations)"""
