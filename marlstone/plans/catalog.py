"""All queries of the library's own operators."""

from __future__ import annotations

from . import aggregate_queries, diagnostic_queries, governance_queries, join_queries, model_queries, polygon_queries, quality_queries, service_queries, source_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
