"""Prices are USD for a million tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column


@dataclass(frozen=True)
class Pricing:
    prompt: float = 0.0
    completion: float = 0.0
    embedding: float = 0.0
    rerank: float = 0.0


def chat_cost(prompt: Column, completion: Column, pricing: Pricing) -> Column:
    return prompt * pricing.prompt / 1e6 + completion * pricing.completion / 1e6


def embedding_cost(tokens: Column, pricing: Pricing) -> Column:
    return tokens * pricing.embedding / 1e6


def rerank_cost(tokens: Column, pricing: Pricing) -> Column:
    return tokens * pricing.rerank / 1e6
