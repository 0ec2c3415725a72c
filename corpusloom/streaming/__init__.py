"""Continuous jobs: indexing, usage counters, rate limits."""

from .jobs import IndexTables, count_usage, counter_table, outcome_table, rate_limit_stream, start_index_stream, start_usage_stream, usage_counters
from .ledger import ClaimLedger, RetryTable

__all__ = ["ClaimLedger", "IndexTables", "RetryTable", "count_usage", "counter_table", "outcome_table", "rate_limit_stream", "start_index_stream", "start_usage_stream", "usage_counters"]
