"""All queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from .plans import analytics_queries, encoding_queries, search_queries, streaming_queries, vector_queries  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
