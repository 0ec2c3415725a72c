"""Column functions: text cleaning, terms, tokens, ids, costs."""

from .costs import chat_cost, embedding_cost, rerank_cost
from .ids import content_hash, idempotency_key, key_digest, object_key, stable_id
from .text import (
    clean_text,
    distinct_in_order,
    estimate_tokens,
    extract_verdict,
    fallback_terms,
    filter_citations,
    lexical_tokens,
    location,
    looks_like_follow_up,
    markdown_heading,
    normalize_evidence,
    primary_terms,
    search_terms,
    sparse_query_terms,
    split_fixed,
    split_paragraphs,
    token_overlap,
)

__all__ = [
    "chat_cost", "clean_text", "content_hash", "distinct_in_order", "embedding_cost", "estimate_tokens", "extract_verdict", "fallback_terms", "filter_citations",
    "idempotency_key", "key_digest", "lexical_tokens", "location", "looks_like_follow_up", "markdown_heading", "normalize_evidence", "object_key", "primary_terms",
    "rerank_cost", "search_terms", "sparse_query_terms", "split_fixed", "split_paragraphs", "stable_id", "token_overlap",
]
