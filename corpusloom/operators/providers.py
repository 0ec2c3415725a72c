"""Plug-in points for user functions (embedder, reranker, chat model, query rewriter, judge) and retries around them.

A user function is called on the executors, for the rows of a partition; it must be picklable.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TransientError(Exception):
    """Raised by a user function for what may work when tried again: networks, 429, 5xx."""


def with_retry(fn: Callable, max_retries: int = 3, first_wait: float = 0.1, sleep=time.sleep) -> Callable:
    """fn, called again after first_wait * 2^n seconds (n at most 6) on transient errors."""

    def call(*args):
        for n in range(max_retries + 1):
            try:
                return fn(*args)
            except (TransientError, ConnectionError, TimeoutError):
                if n == max_retries:
                    raise
                sleep(first_wait * 2 ** min(n, 6))

    return call


def rerank_scores(candidates: DataFrame, reranker: Callable[[str, list[str]], list[float]], batch: int = 50) -> DataFrame:
    """candidates (query_id, chunk_id, question, content, rank) -> (query_id, chunk_id, rerank_score).

    Each query's candidates are one bounded group (top-k); the reranker gets at most `batch` documents a call.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        call = with_retry(reranker)
        pdf = pdf.sort_values(["rank", "chunk_id"])
        scores = [float(s) for a in range(0, len(pdf), batch) for s in call(pdf["question"].iloc[0], pdf["content"].iloc[a : a + batch].tolist())]
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "rerank_score": scores})

    kinds = dict(candidates.dtypes)
    return candidates.select("query_id", "chunk_id", "question", "content", "rank").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, rerank_score double")


def chat_answers(request: Column, chat: Callable[[dict], dict]) -> Column:
    """struct<text, prompt_tokens, completion_tokens> of a user's chat model; request: a struct, given as a dict."""
    schema = "text string, prompt_tokens int, completion_tokens int"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retry(chat)
        for texts in batches:
            yield pd.DataFrame([call(json.loads(t)) for t in texts], columns=["text", "prompt_tokens", "completion_tokens"])

    return run(F.to_json(request))


def rewritten(history: Column, question: Column, rewriter: Callable[[list[dict], str], str]) -> Column:
    """The question as a user's rewriter puts it; null where it fails or gives blank text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = with_retry(rewriter)

        def one(text):
            x = json.loads(text)
            try:
                return (call(x.get("history") or [], x.get("question") or "") or "").strip() or None
            except Exception:  # any failure falls back to the question as it was
                return None

        for texts in batches:
            yield texts.map(one)

    return run(F.to_json(F.struct(history.alias("history"), question.alias("question"))))


def judged(case: Column, judge: Callable[[dict], dict]) -> Column:
    """The verdict struct of a user's judge for a case struct (question, reference, answer, evidence)."""
    names = ["answer_correct", "evidence_supported", "correct_refusal", "hallucination", "rationale"]

    @F.pandas_udf("answer_correct boolean, evidence_supported boolean, correct_refusal boolean, hallucination boolean, rationale string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retry(judge)
        for texts in batches:
            yield pd.DataFrame([call(json.loads(t)) for t in texts], columns=names)

    return run(F.to_json(case))
