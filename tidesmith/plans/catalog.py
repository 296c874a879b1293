"""Every registered query with its oracle SQL."""

from __future__ import annotations

from . import engines, evaluations, recursions, scores, signals, texts  # noqa: F401  they register their queries
from .book import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
