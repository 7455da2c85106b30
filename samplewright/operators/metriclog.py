"""Scalar metrics as a tall (step, name, value) table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_rows(wide: DataFrame, step: str, names: Sequence[str]) -> DataFrame:
    """One row per step and metric from one column per metric."""
    doubles = wide.select(step, *[F.col(n).cast("double").alias(n) for n in names])
    return doubles.unpivot([step], list(names), "name", "value")


def log_every(metrics: DataFrame, step: str, every: int = 200, stop_at: int | None = None) -> DataFrame:
    """The rows a periodic log keeps: every ``every`` steps, to the end or up to but not including ``stop_at``."""
    kept = metrics.filter(F.col(step) % every == 0)
    return kept if stop_at is None else kept.filter(F.col(step) < stop_at)
