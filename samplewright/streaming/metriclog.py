"""Appending periodic metrics of a running job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.metriclog import log_every


def start_metric_log(
    metrics: DataFrame,
    path: str,
    checkpoint: str,
    step: str = "step",
    every: int = 200,
    stop_at: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Writes the logged rows of a (step, name, value) stream to Parquet, each exactly once."""
    kept = log_every(metrics, step, every, stop_at)
    writer = kept.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(path)
