"""Moving mean and variance of a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.moments import moving_moments

# A window's count, mean and sum of squared deviations; two rows of a window merge exactly.
_PARTS = ("n", "mean", "m2")


def start_moving_moments(
    events: DataFrame,
    keys: Sequence[str],
    batch: str,
    value: str,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Gathers what the moving moments of a stream need at ``path``; :func:`read_moving_moments` folds it.

    ``batch`` names the column whose values, in ascending order, are the updates (a step, a day). Each
    micro-batch adds one row per key and batch it holds, in a folder of its own that a repeated micro-batch
    overwrites, so its rows count once. Nothing written earlier is read or written again, rows may come in
    any order, and none is ever too late. Null values don't count, as in a batch aggregate.
    """
    keys = list(keys)

    def add(rows: DataFrame, version: int) -> None:
        x = F.col(value).cast("double")
        parts = rows.groupBy(*keys, batch).agg(
            F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2")
        )
        parts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={version}")

    writer = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_batches(spark: SparkSession, path: str, keys: Sequence[str], batch: str) -> DataFrame:
    """Mean and variance per (keys, batch) of all that has arrived so far."""
    parts = spark.read.parquet(path).where("n > 0")
    whole = parts.groupBy(*keys, batch).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.collect_list(F.struct(*_PARTS)).alias("_parts"),  # one for each micro-batch that held the batch
    )
    spread = F.aggregate(
        F.col("_parts"), F.lit(0.0),
        lambda acc, p: acc + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")),
    )
    return whole.select(*keys, batch, "mean", (spread / F.col("n")).alias("variance"))


def read_moving_moments(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    batch: str,
    decay: float = 0.999,
    initial_mean: float = 0.0,
    initial_variance: float = 1.0,
) -> DataFrame:
    """The moving moments per key, one update for each batch in order, the latest one included."""
    return moving_moments(read_batches(spark, path, keys, batch), batch, keys, decay, initial_mean, initial_variance)
