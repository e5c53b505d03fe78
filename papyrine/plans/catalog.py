"""All queries of the core, with their SQL where it exists."""

from __future__ import annotations

from papyrine.plans import analysis_queries, comparison_queries, model_queries, more_queries  # noqa: F401
from papyrine.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
