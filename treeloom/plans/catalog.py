"""The catalogue of queries over the driver's tables, with their SQL."""

from __future__ import annotations

from treeloom.plans import aggregate_queries, interval_queries, sequence_queries, source_queries, surface_queries, text_queries, tree_queries  # noqa: F401
from treeloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
