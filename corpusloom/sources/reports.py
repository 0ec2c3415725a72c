"""Evaluation reports as rows of lines, to be written as text by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import Pricing
from ..operators.order import numbered

FAILURES_SHOWN = 5


def _lines(section: int, df: DataFrame, order: list, line: Column) -> DataFrame:
    """(section, ord, line) of df's rows in an order."""
    return numbered(df.withColumn("_line", line), order, "ord").select(F.lit(section).alias("section"), "ord", F.col("_line").alias("line"))


def _text(df: DataFrame, section: int, *lines: str) -> DataFrame:
    rows = [(section, i - len(lines), x) for i, x in enumerate(lines)]
    return df.sparkSession.createDataFrame(rows, "section int, ord long, line string")


def _numbered(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out, ["section", "ord"], "line_no").select("line_no", "line")


def report_json(metrics: DataFrame) -> DataFrame:
    """(value): one JSON object for each strategy."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value"))


def report_markdown(configs: DataFrame, metrics: DataFrame, failures: DataFrame, pricing: Pricing | None = None) -> DataFrame:
    """(line_no, line) of a report: configs (ord, strategy, dense_top_k, sparse_top_k, rrf_k, rerank_enabled, rerank_top_k, final_top_k), metrics (ord, strategy and
    the columns of retrieval_metrics), failures (ord, strategy, id, first_relevant_rank, citation_hit, error), of which each strategy's first few are shown.

    Lines are numbered by ranges of their order, so that a report of any length is made by many tasks.
    """
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    config = F.format_string("| %s | %d | %d | %d | %s | %d | %d |", "strategy", "dense_top_k", "sparse_top_k", "rrf_k", yes("rerank_enabled"), "rerank_top_k", "final_top_k")
    figures = F.format_string(
        "| %s | %.4f | %.4f | %.4f | %.4f | %.4f | %.3f / %.3f | %.3f / %.3f | %.2f | %.8f |",
        *("strategy recall_at_1 recall_at_5 recall_at_10 mrr citation_hit_rate avg_retrieval_latency_ms p95_retrieval_latency_ms avg_end_to_end_latency_ms p95_end_to_end_latency_ms avg_tokens avg_estimated_cost_usd".split()),
    )
    shown = failures.withColumn("_n", F.row_number().over(Window.partitionBy("strategy").orderBy("id"))).filter(F.col("_n") <= FAILURES_SHOWN)
    error = F.regexp_replace(F.coalesce("error", F.lit("")), r"\|", "/")  # a bar would end the cell
    failure = F.format_string("| %s | %s | %d | %s | %s |", "strategy", "id", "first_relevant_rank", yes("citation_hit"), error)
    best = F.format_string("Best: %s (Recall@10 %.4f, MRR %.4f).", "strategy", "recall_at_10", "mrr")
    prices = () if pricing is None else (f"USD per million tokens: prompt {pricing.prompt:.4f}, completion {pricing.completion:.4f}, embedding {pricing.embedding:.4f}, rerank {pricing.rerank:.4f}", "")
    return _numbered(
        _text(metrics, 1, "# Retrieval evaluation", "", *prices, "| Strategy | Dense | Sparse | RRF k | Reranked | Rerank k | Final |", "|---|---:|---:|---:|---|---:|---:|"),
        _lines(1, configs, ["ord"], config),
        _text(metrics, 2, "", "| Strategy | Recall@1 | Recall@5 | Recall@10 | MRR | Citation hits | Retrieval ms, mean / P95 | End to end ms, mean / P95 | Avg tokens | Avg USD |", "|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|"),
        _lines(2, metrics, ["ord"], figures),
        _text(metrics, 3, "", "## Failures", "", "| Strategy | Case | First relevant | Cited | Error |", "|---|---|---:|---|---|"),
        _lines(3, shown, ["ord", "id"], failure),
        _text(metrics, 4, "", "## Conclusions", ""),
        _lines(4, metrics.orderBy(F.desc("recall_at_10"), F.desc("mrr"), "ord").limit(1), ["ord"], best),
    )


def answer_report_markdown(metrics: DataFrame, formats: DataFrame, failures: DataFrame, usage: DataFrame) -> DataFrame:
    """(line_no, line): overall figures by strategy (ord, answer_metrics), by format (format_metrics), failures (strategy, id, failure_reason), provider_usage."""
    overall = F.format_string("| %s | %.3f | %.3f | %.3f | %.3f | %.3f | %.1f | %.6f |", *("strategy recall_at_10 mrr answer_accuracy correct_refusal_rate hallucination_rate avg_tokens total_cost_usd".split()))
    by_format = F.format_string("| %s | %d | %d | %.3f | %.3f | %.3f |", *("format cases succeeded success_rate answer_accuracy hallucination_rate".split()))
    calls = F.format_string("| %s | %s | %d | %d | %d | %d | %d |", *("request_type model calls prompt_tokens completion_tokens text_count failed".split()))
    return _numbered(
        _text(metrics, 1, "# Answer evaluation", "", "| Strategy | Recall@10 | MRR | Correct | Refusals | Hallucination | Avg tokens | USD |", "|---|---:|---:|---:|---:|---:|---:|---:|"),
        _lines(1, metrics, ["ord"], overall),
        _text(metrics, 2, "", "| Format | Cases | Succeeded | Success | Correct | Hallucination |", "|---|---:|---:|---:|---:|---:|"),
        _lines(2, formats, ["ord"], by_format),
        _text(metrics, 3, "", "## Failures", ""),
        _lines(3, failures, ["strategy", "id"], F.format_string("- %s, %s: %s", "strategy", "id", "failure_reason")),
        _text(metrics, 4, "", "| Type | Model | Calls | Prompt tokens | Completion tokens | Texts | Failed |", "|---|---|---:|---:|---:|---:|---:|"),
        _lines(4, usage, ["request_type", "model"], calls),
    )
