"""All queries of the library but those of its text package."""

from __future__ import annotations

from . import q_audits, q_columns, q_design, q_joins, q_ml, q_models, q_more, q_panel, q_results, q_sources, q_surrogate, q_timing, q_windows  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
