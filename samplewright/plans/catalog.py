"""All registered queries."""

from __future__ import annotations

from . import feed_queries, metric_queries, raster_queries, vector_queries  # noqa: F401  (they register themselves)
from .registry import ORACLES, QUERIES, Build


def queries() -> dict[str, Build]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
