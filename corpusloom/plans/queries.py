"""All registered queries of the knowledge-base jobs."""

from . import evaluation_queries, more_queries, service_queries, text_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
