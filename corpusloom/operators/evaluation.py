"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import Pricing, embedding_cost, rerank_cost
from ..functions.ids import content_hash, stable_id
from ..functions.text import estimate_tokens
from ..sources.checkpoints import checkpointed
from .order import nearest_ranks

FORMATS = ("pdf", "docx", "markdown", "txt")
# Reasons of failed answers, and their separator.
NOT_REFUSED, INCORRECT, UNSUPPORTED, HALLUCINATED, REASON_JOIN = "未正确拒答", "答案不正确", "引用证据不支持", "幻觉", "；"


LATENCIES = ("retrieval_latency_ms", "end_to_end_latency_ms")


def _with_p95s(metrics: DataFrame, cases: DataFrame, *columns: str) -> DataFrame:
    """metrics by strategy + p95_... of the cases' columns, by nearest rank; no group's values are gathered."""
    ranks = nearest_ranks(cases, ["strategy"], list(columns), 0.95).select(F.col("strategy").alias("_s"), *(F.col(c).alias(f"p95_{c}") for c in columns))
    return metrics.join(ranks, metrics.strategy.eqNullSafe(ranks["_s"]), "left").drop("_s")


def mark_relevant(results: DataFrame, questions: DataFrame) -> DataFrame:
    """results (query_id, chunk_id, document_id) + relevant: expected by the question (query_id, expected_chunk_ids, expected_document_ids)."""
    df = results.join(questions.select("query_id", "expected_chunk_ids", "expected_document_ids"), "query_id")
    hit = F.coalesce(F.array_contains("expected_chunk_ids", F.col("chunk_id")), F.lit(False)) | F.coalesce(F.array_contains("expected_document_ids", F.col("document_id")), F.lit(False))
    return df.withColumn("relevant", hit).drop("expected_chunk_ids", "expected_document_ids")


def mark_source_relevant(results: DataFrame, questions: DataFrame) -> DataFrame:
    """results (query_id, filename) + relevant: the file is one of the question's expected_sources."""
    df = results.join(questions.select("query_id", "expected_sources"), "query_id")
    return df.withColumn("relevant", F.coalesce(F.array_contains("expected_sources", F.col("filename")), F.lit(False))).drop("expected_sources")


def citation_hits(citations: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, citation_hit) of all questions: a cited filename is an expected source."""
    cited = citations.groupBy("query_id").agg(F.collect_set("filename").alias("files"))
    return questions.join(cited, "query_id", "left").select("query_id", F.coalesce(F.arrays_overlap("files", "expected_sources"), F.lit(False)).alias("citation_hit"))


def first_relevant_rank(marked: DataFrame) -> DataFrame:
    """(query_id, first_relevant_rank): 0 if none is relevant."""
    return marked.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0)).alias("first_relevant_rank"))


def _rank_measures() -> list[Column]:
    r = F.col("first_relevant_rank")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return [share(r == 1).alias("recall_at_1"), share(r.between(1, 5)).alias("recall_at_5"), share(r.between(1, 10)).alias("recall_at_10"), F.avg(F.when(r > 0, 1 / r).otherwise(0.0)).alias("mrr"), share(F.col("citation_hit")).alias("citation_hit_rate")]


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """One row for each strategy: recall, MRR, citation hits, averages and P95s."""
    mean = lambda c: F.avg(c).alias(f"avg_{c}")
    cases = checkpointed(cases)  # read once for the measures and once a pass for the ranks
    measures = cases.groupBy("strategy").agg(F.count("*").alias("n_cases"), *_rank_measures(), *(mean(c) for c in (*LATENCIES, "tokens", "estimated_cost_usd")))
    return _with_p95s(measures, cases, *LATENCIES)


def case_success(df: DataFrame) -> DataFrame:
    """(error, unanswerable and a verdict's flags) + success."""
    c = F.col
    good = F.when(c("unanswerable"), c("correct_refusal")).otherwise(c("answer_correct") & c("evidence_supported"))
    return df.withColumn("success", (F.coalesce("error", F.lit("")) == "") & ~c("hallucination") & good)


def failure_reason(df: DataFrame) -> DataFrame:
    """+ failure_reason: what went wrong, joined; empty where nothing did."""
    c = F.col
    parts = (
        F.when(F.coalesce("error", F.lit("")) != "", c("error")),
        F.when(c("unanswerable") & ~c("correct_refusal"), NOT_REFUSED),
        F.when(~c("unanswerable") & ~c("answer_correct"), INCORRECT),
        F.when(~c("unanswerable") & ~c("evidence_supported"), UNSUPPORTED),
        F.when(c("hallucination"), HALLUCINATED),
    )
    return df.withColumn("failure_reason", F.concat_ws(REASON_JOIN, *parts))


def _rate(flag: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(flag & of), F.count_if(of)), F.lit(0.0))


def answer_metrics(cases: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each strategy. Ranks, correctness and support count over answerable questions, refusals over unanswerable ones, the rest over all."""
    c = F.col
    df = checkpointed(cases.join(questions.select("id", "unanswerable"), "id"))
    yes, r = ~c("unanswerable"), c("first_relevant_rank")
    measures = df.groupBy("strategy").agg(
        _rate(r == 1, yes).alias("recall_at_1"),
        _rate(r.between(1, 5), yes).alias("recall_at_5"),
        _rate(r.between(1, 10), yes).alias("recall_at_10"),
        F.coalesce(F.try_divide(F.sum(F.when(yes & (r > 0), 1 / r)), F.count_if(yes)), F.lit(0.0)).alias("mrr"),
        _rate(c("citation_hit"), yes).alias("citation_hit_rate"),
        _rate(c("answer_correct"), yes).alias("answer_accuracy"),
        _rate(c("evidence_supported"), yes).alias("evidence_support_rate"),
        _rate(c("correct_refusal"), c("unanswerable")).alias("correct_refusal_rate"),
        _rate(c("hallucination"), F.lit(True)).alias("hallucination_rate"),
        F.sum("tokens").alias("total_tokens"),
        F.avg("tokens").alias("avg_tokens"),
        F.sum("estimated_cost_usd").alias("total_cost_usd"),
        F.avg("retrieval_latency_ms").alias("avg_retrieval_latency_ms"),
    )
    return _with_p95s(measures, df, *LATENCIES)


def _by_format(cases: DataFrame, questions: DataFrame, formats) -> DataFrame:
    df = failure_reason(case_success(cases.join(questions.select("id", "unanswerable", "tags"), "id")))
    return df.withColumn("format", F.explode(F.array_intersect("tags", F.array(*map(F.lit, formats)))))


def format_metrics(cases: DataFrame, questions: DataFrame, formats=FORMATS) -> DataFrame:
    """One row for each format, in order and 0 where it has no cases: counts and rates. format_failures has the failures."""
    c = F.col
    spark = cases.sparkSession
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(formats)], "ord int, format string")
    df = _by_format(cases, questions, formats)
    yes = ~c("unanswerable")
    agg = df.groupBy("format").agg(
        F.count("*").alias("cases"),
        F.count_if("success").alias("succeeded"),
        _rate(c("success"), F.lit(True)).alias("success_rate"),
        _rate(c("answer_correct"), yes).alias("answer_accuracy"),
        _rate(c("evidence_supported"), yes).alias("evidence_support_rate"),
        _rate(c("correct_refusal"), c("unanswerable")).alias("correct_refusal_rate"),
        _rate(c("hallucination"), F.lit(True)).alias("hallucination_rate"),
    )
    out = rows.join(agg, "format", "left")
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("cases", "succeeded")} | {k: F.coalesce(k, F.lit(0.0)) for k in agg.columns if k.endswith(("rate", "accuracy"))}
    return out.withColumns(zero)


def format_failures(cases: DataFrame, questions: DataFrame, formats=FORMATS) -> DataFrame:
    """(format, strategy, id, failure_reason), a row for each failed case and format."""
    return _by_format(cases, questions, formats).filter(~F.col("success")).select("format", "strategy", "id", "failure_reason")


def failure_cases(cases: DataFrame) -> DataFrame:
    r = F.col("first_relevant_rank")
    return cases.filter((F.coalesce("error", F.lit("")) != "") | (r == 0) | (r > 10) | ~F.col("citation_hit"))


def best_strategy(metrics: DataFrame) -> DataFrame:
    """The strategy with the best recall at 10, then MRR, then the first by `ord`."""
    return metrics.orderBy(F.desc("recall_at_10"), F.desc("mrr"), "ord").limit(1)


def conclusions(metrics: DataFrame) -> DataFrame:
    """(ord, line): one sentence for each strategy with its figures."""
    line = F.format_string("%s: Recall@10 %.3f, MRR %.3f, citation hits %.3f.", "strategy", "recall_at_10", "mrr", "citation_hit_rate")
    return metrics.select("ord", line.alias("line"))


def pending_cases(wanted: DataFrame, done: DataFrame, forced: tuple[str, ...] = ()) -> DataFrame:
    """(strategy, id) still to run: not done yet, or of a forced strategy."""
    return wanted.join(done.filter(~F.col("strategy").isin(*forced)) if forced else done, ["strategy", "id"], "left_anti")


def complete_strategies(done: DataFrame, questions: DataFrame) -> DataFrame:
    """Strategies with as many cases as there are questions."""
    n = questions.agg(F.count("*").alias("n"))
    return done.groupBy("strategy").agg(F.count("*").alias("k")).join(F.broadcast(n)).filter("k = n").select("strategy")


def case_costs(cases: DataFrame, pricing: Pricing) -> DataFrame:
    """(question, contents array, dense, rerank, chat_tokens, chat_cost) + tokens, estimated_cost_usd."""
    size = lambda c: estimate_tokens(c, "usage")
    embedding = F.when(F.col("dense"), size(F.col("question"))).otherwise(0)
    reranked = F.when(F.col("rerank"), size(F.col("question")) + F.aggregate("contents", F.lit(0), lambda s, x: s + size(x))).otherwise(0)
    return cases.withColumns({"tokens": F.col("chat_tokens") + embedding + reranked, "estimated_cost_usd": F.col("chat_cost") + embedding_cost(embedding, pricing) + rerank_cost(reranked, pricing)})


def seed_corpus(questions: DataFrame, namespace: str) -> DataFrame:
    """One document of one chunk for each question: (document_id, chunk_id, knowledge_base, content, content_hash, token_count)."""
    text = F.concat(F.lit("Question: "), "question", F.lit("\nAnswer: "), "reference_answer", F.lit("\nTags: "), F.array_join("tags", ", "))
    return questions.select(
        stable_id(F.element_at("expected_document_ids", 1), namespace).alias("document_id"),
        stable_id(F.element_at("expected_chunk_ids", 1), namespace).alias("chunk_id"),
        "knowledge_base",
        text.alias("content"),
        content_hash(text).alias("content_hash"),
        estimate_tokens(text, "usage").alias("token_count"),
    )


def question_errors(df: DataFrame, least_rows: int = 50) -> DataFrame:
    """(id, error) of a question set: blank fields, no expectation, repeated ids, too few rows (id null)."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    n = F.count("*").over(Window.partitionBy("id"))
    error = F.when(blank("id") | blank("knowledge_base") | blank("question") | blank("reference_answer"), "BLANK_FIELD").when(~some("expected_document_ids") & ~some("expected_chunk_ids"), "NO_EXPECTATION").when(F.col("_n") > 1, "DUPLICATE_ID")
    rows = df.withColumn("_n", n).select("id", error.alias("error")).filter("error is not null")
    few = df.agg(F.count("*").alias("n")).filter(F.col("n") < least_rows).select(F.lit(None).cast("string").alias("id"), F.lit("TOO_FEW_ROWS").alias("error"))
    return rows.union(few)


def answer_question_errors(df: DataFrame, least_rows: int = 60) -> DataFrame:
    """As question_errors for answer sets: only unanswerable questions may go without expected sources and evidence."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    n = F.count("*").over(Window.partitionBy("id"))
    error = F.when(blank("id") | blank("question") | blank("reference_answer"), "BLANK_FIELD").when(~F.coalesce("unanswerable", F.lit(False)) & (none("expected_sources") | none("expected_evidence")), "NO_EXPECTATION").when(F.col("_n") > 1, "DUPLICATE_ID")
    rows = df.withColumn("_n", n).select("id", error.alias("error")).filter("error is not null")
    few = df.agg(F.count("*").alias("n")).filter(F.col("n") < least_rows).select(F.lit(None).cast("string").alias("id"), F.lit("TOO_FEW_ROWS").alias("error"))
    return rows.union(few)
