"""Conversations: history, rewriting, context budgets, prompts, answers, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filter_citations, location, looks_like_follow_up
from .providers import rewritten

MAX_CONTEXT_TOKENS = 8000
# The texts of the offline model.
ANSWER_PREFIX = "根据知识库证据，"
REFUSAL = "当前知识库中没有足够信息。"
FOLLOW_UP_JOIN = "；后续问题："


def limit_context(results: DataFrame, max_tokens: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """Of each query's results (rank, content, token_count) the first, and then the longest prefix within the budget. Stops at the first that overflows."""
    tokens = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(F.greatest(F.floor(F.length("content") / 4), F.lit(1)))
    w = Window.partitionBy("query_id").orderBy("rank")
    df = results.withColumn("_sum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return df.filter((F.col("_n") == 1) | (F.col("_sum") <= max_tokens)).drop("_sum", "_n")


def number_evidence(results: DataFrame) -> DataFrame:
    """+ number: 1..n by rank within each query."""
    return results.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def with_history(messages: DataFrame, n: int = 20) -> DataFrame:
    """messages (conversation_id, ord, role, status, content) + history: the n messages before each, oldest first."""
    before = Window.partitionBy("conversation_id").orderBy("ord").rowsBetween(-n, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "status", "content")).over(before))


def recent_completed(history: Column, n: int = 6) -> Column:
    """The last n completed user and assistant messages of a history."""
    kept = F.filter(history, lambda m: (m["status"] == "completed") & m["role"].isin("user", "assistant"))
    return F.slice(kept, F.greatest(F.size(kept) - (n - 1), F.lit(1)), F.lit(n))


def valid_messages(df: DataFrame, column: str = "content") -> DataFrame:
    """Messages of 1 to 20,000 characters, trimmed."""
    text = F.regexp_replace(F.col(column), r"\A\s+|\s+\z", "")
    return df.withColumn(column, text).filter(F.length(column).between(1, 20_000))


def rewrite_queries(df: DataFrame, rewriter=None) -> DataFrame:
    """(question, history) + query, rewrite_applied, rewrite_fallback.

    Without a rewriter of the user, a follow-up question is put behind the last user message.
    """
    recent = recent_completed(F.col("history"))
    if rewriter is None:
        last = F.try_element_at(F.filter(recent, lambda m: (m["role"] == "user") & (F.trim(m["content"]) != "")), F.lit(-1))["content"]
        joined = F.concat(F.trim(last), F.lit(FOLLOW_UP_JOIN), F.col("question"))
        query = F.when(looks_like_follow_up(F.col("question")) & last.isNotNull(), joined).otherwise(F.col("question"))
    else:
        query = rewritten(recent, F.col("question"), rewriter)
    df = df.withColumn("_query", query)
    return df.withColumns(
        {
            "query": F.coalesce("_query", "question"),
            "rewrite_applied": F.coalesce(F.col("_query") != F.col("question"), F.lit(False)),
            "rewrite_fallback": F.col("_query").isNull(),
        }
    ).drop("_query")


def build_prompts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """queries (query_id, question, history), results (query_id, number, filename, content, page_start, page_end, heading_path, chunk_index) -> queries + prompt, n_evidence."""
    where = location(F.col("page_start"), F.col("page_end"), F.col("heading_path"), F.col("chunk_index"))
    line = F.format_string("[%d] file=%s location=%s\n%s\n\n", "number", "filename", where, "content")
    blocks = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "").alias("_evidence"), F.count("*").alias("n_evidence"))
    history = F.filter("history", lambda m: m["status"] == "completed")
    talk = F.array_join(F.transform(history, lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"))), "")
    df = queries.join(blocks, "query_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)).cast("long"))
    return df.withColumn("prompt", F.concat(talk, F.coalesce("_evidence", F.lit("")), F.col("question"))).drop("_evidence")


def offline_answers(df: DataFrame) -> DataFrame:
    """(query_id, first_evidence) + answer."""
    some = F.coalesce(F.trim("first_evidence"), F.lit("")) != ""
    return df.withColumn("answer", F.when(some, F.concat(F.lit(ANSWER_PREFIX), F.trim("first_evidence"), F.lit(" [1]"))).otherwise(F.lit(REFUSAL)))


def resolve_citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """answers (query_id, answer), numbered results -> (query_id, number, document_id, chunk_id, filename, location, content), one row for each marker that points at evidence."""
    most = results.groupBy("query_id").agg(F.max("number").alias("most"))
    cited = answers.join(most, "query_id").select("query_id", F.posexplode(filter_citations(F.col("answer"), F.col("most"))["numbers"]).alias("ord", "number"))
    where = location(F.col("page_start"), F.col("page_end"), F.col("heading_path"), F.col("chunk_index"))
    return cited.join(results, ["query_id", "number"]).select("query_id", "ord", "number", "document_id", "chunk_id", "filename", where.alias("location"), "content")


def retrieval_trace(results: DataFrame, responses: DataFrame) -> DataFrame:
    """(query_id, trace): a JSON object of strategy, counts and ranked hits."""
    hits = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("hits"))
    df = responses.join(hits, "query_id", "left")
    return df.select("query_id", F.to_json(F.struct("strategy", "n_dense", "n_sparse", "rerank_fallback", "hits")).alias("trace"))
