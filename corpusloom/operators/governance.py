"""Usage, costs, counts and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import Pricing

JOB_STATUSES = ("pending", "running", "succeeded", "failed")
#: Default upper bounds of latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
MAX_PAGE = 100


def usage_entries(calls: DataFrame, pricing: Pricing) -> DataFrame:
    """calls (request_type, prompt_tokens, completion_tokens, text_count, latency_ms, error) + estimated_cost_usd, status, error_code."""
    c = F.col
    cost = (
        F.when(c("request_type") == "chat", c("prompt_tokens") * pricing.prompt / 1e6 + c("completion_tokens") * pricing.completion / 1e6)
        .when(c("request_type") == "embedding", c("prompt_tokens") * pricing.embedding / 1e6)
        .otherwise(c("prompt_tokens") * pricing.rerank / 1e6)
    )
    code = F.when(c("error").isNull() | (c("error") == ""), None).when(c("error") == "canceled", "CANCELED").when(c("error") == "deadline exceeded", "TIMEOUT").otherwise("PROVIDER_ERROR")
    return calls.withColumns({"estimated_cost_usd": cost.cast("decimal(18,8)"), "error_code": code}).withColumn("status", F.when(F.col("error_code").isNull(), "succeeded").otherwise("failed"))


def governance_summary(users: DataFrame, kbs: DataFrame, docs: DataFrame, jobs: DataFrame, usage: DataFrame) -> DataFrame:
    """One row of totals; 0 where a table is empty. Each table is reduced to one row before they meet."""
    parts = [
        users.agg(F.count("*").alias("users")),
        kbs.agg(F.count_if(F.col("deleted_at").isNull()).alias("active_kbs")),
        docs.agg(F.count_if(F.col("deleted_at").isNull() & (F.col("status") == "ready")).alias("ready_documents")),
        jobs.agg(F.count_if(F.col("status") == "failed").alias("failed_jobs")),
        usage.agg(
            F.count("*").alias("calls"),
            F.coalesce(F.try_divide(F.count_if(F.col("status") == "succeeded"), F.count("*")), F.lit(0.0)).alias("success_rate"),
            F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
            F.coalesce(F.sum("estimated_cost_usd"), F.lit(0)).alias("cost_usd"),
        ),
    ]
    rows = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = rows[0]
    for p in rows[1:]:
        out = out.join(p, "_one")
    return out.drop("_one")


def provider_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("request_type", "model").agg(
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("text_count").alias("text_count"),
        F.sum("estimated_cost_usd").alias("cost_usd"),
        F.count_if(F.col("status") != "succeeded").alias("failed"),
    )


def kb_counts(kbs: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(knowledge_base_id, documents, chunks): active documents, and chunks at the current version of ready ones. Chunks are counted per document first."""
    active = docs.filter("deleted_at is null")
    per_doc = chunks.groupBy("document_id", "index_version").agg(F.count("*").alias("n"))
    counted = active.join(per_doc, (active.id == per_doc.document_id) & (active.index_version == per_doc.index_version), "left")
    per_kb = counted.groupBy("knowledge_base_id").agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col("n"))), F.lit(0)).alias("chunks"))
    out = kbs.filter("deleted_at is null").select(F.col("id").alias("knowledge_base_id")).join(per_kb, "knowledge_base_id", "left")
    return out.na.fill(0, ["documents", "chunks"])


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """(status, n) of the four statuses, 0 where there are none."""
    rows = jobs.sparkSession.createDataFrame([(s,) for s in JOB_STATUSES], "status string")
    return rows.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0, ["n"])


def audit_index(docs: DataFrame, jobs: DataFrame, chunks: DataFrame, dimension: int = 1024) -> DataFrame:
    """One row for each knowledge base: documents, ready ones, their chunk sum, jobs that succeeded at the current version, vectors of the right dimension, consistent."""
    active = docs.filter("deleted_at is null")
    a = active.groupBy("knowledge_base_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_sum"))
    done = jobs.filter("status = 'succeeded'").select("document_id", "index_version")
    b = active.select(F.col("id").alias("document_id"), "index_version", "knowledge_base_id").join(done, ["document_id", "index_version"]).groupBy("knowledge_base_id").agg(F.count("*").alias("jobs_succeeded"))
    c = chunks.groupBy("knowledge_base_id").agg(F.count_if(F.size("embedding") == dimension).alias("vectors"))
    out = a.join(b, "knowledge_base_id", "left").join(c, "knowledge_base_id", "left").na.fill(0, ["jobs_succeeded", "vectors"])
    return out.withColumn("consistent", (F.col("documents") == F.col("ready")) & (F.col("documents") == F.col("jobs_succeeded")) & (F.col("chunk_sum") == F.col("vectors")))


def http_counters(http: DataFrame) -> DataFrame:
    return http.groupBy("method", "route", "status").agg(F.count("*").alias("n"))


def model_counters(usage: DataFrame) -> DataFrame:
    """(metric, request_type, model, label, n): requests by status, errors by code of failed calls only, texts embedded."""
    base = ["request_type", "model"]
    requests = usage.groupBy(*base, F.col("status").alias("label")).agg(F.count("*").alias("n")).withColumn("metric", F.lit("requests"))
    errors = usage.filter("status <> 'succeeded'").groupBy(*base, F.col("error_code").alias("label")).agg(F.count("*").alias("n")).withColumn("metric", F.lit("errors"))
    texts = usage.filter("request_type = 'embedding'").groupBy(*base).agg(F.sum("text_count").alias("n")).withColumns({"label": F.lit(None).cast("string"), "metric": F.lit("texts")})
    columns = ["metric", *base, "label", "n"]
    return requests.select(*columns).unionByName(errors.select(*columns)).unionByName(texts.select(*columns))


def latency_histogram(df: DataFrame, labels: list[str], seconds: Column, buckets=BUCKETS) -> DataFrame:
    """(labels, le, n, total, sum): cumulative counts by upper bound, null for no bound. One pass: a conditional count for each bucket."""
    df = df.withColumn("_s", seconds)
    counts = df.groupBy(*labels).agg(*(F.count_if(F.col("_s") <= b).alias(f"b{i}") for i, b in enumerate(buckets)), F.count("_s").alias("total"), F.sum("_s").alias("sum"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)), F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return counts.select(*labels, F.explode(rows).alias("r"), "total", "sum").select(*labels, "r.le", "r.n", "total", "sum")


def page(df: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """Rows of a page, counted from 1, in an order that must include a unique key."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError("page from 1, size from 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(df: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """page() + total, the number of rows of df."""
    return page(df, order, number, size).join(F.broadcast(df.agg(F.count("*").alias("total"))))


def disable_users(users: DataFrame, tokens: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(users, tokens) after the users in ids (id) are disabled and their open tokens revoked."""
    mark = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    u = users.join(mark, "id", "left").withColumns({"status": F.when(F.col("_hit"), "disabled").otherwise(F.col("status")), "updated_at": F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))}).drop("_hit")
    t = tokens.join(mark.withColumnRenamed("id", "user_id"), "user_id", "left")
    t = t.withColumn("revoked_at", F.when(F.col("_hit") & F.col("revoked_at").isNull(), now).otherwise(F.col("revoked_at"))).drop("_hit")
    return u.select(*users.columns), t.select(*tokens.columns)
