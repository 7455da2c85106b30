"""Operators that look up parameters by class: embedding, conditional normalisation, projection score.

Class tables are joined without a broadcast hint. Spark broadcasts them while they stay below
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a shuffled join, split by adaptive
execution where a class is hot, when they do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, doubles, same_size, vector_literal, whole_div
from .asof import as_of
from .moments import channel_moments, moments_as_arrays
from .raster import spatial_sum

EPSILON = 1e-5
STATS = "struct<mean:array<double>,variance:array<double>>"


def lookup_class(df: DataFrame, class_id: str, table: DataFrame, fail_on_unknown: bool = True) -> DataFrame:
    """Left join to a class table; a class the table lacks is an error unless told otherwise."""
    known = table.withColumn("_known", F.lit(True))
    joined = df.join(known, class_id, "left")
    if fail_on_unknown:
        fault = F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(class_id).cast("string"), F.lit("null"))))
        joined = joined.filter(F.coalesce(F.col("_known"), fault.cast("boolean")))
    return joined.drop("_known")


def unknown_classes(df: DataFrame, class_id: str, table: DataFrame) -> DataFrame:
    """Rows whose class the table lacks."""
    return df.join(table.select(class_id), class_id, "left_anti")


def _normalize(
    image: Column, stats: Column, gamma: Column, beta: Column, channels: int, epsilon: float
) -> Column:
    # scale = gamma / sqrt(var + eps) and shift = beta - mean * scale are per channel, not per element.
    scales = F.zip_with(doubles(gamma), stats["variance"], lambda g, s: g / F.sqrt(s + epsilon))
    factors = F.zip_with(
        F.arrays_zip(scales.alias("scale"), doubles(beta).alias("beta")),
        stats["mean"],
        lambda f, m: F.struct(f["scale"].alias("scale"), (f["beta"] - m * f["scale"]).alias("shift")),
    )
    tiled = F.flatten(F.array_repeat(factors, whole_div(F.size(image), channels).cast("int")))
    return F.zip_with(same_size(doubles(image), tiled), tiled, lambda x, f: x * f["scale"] + f["shift"])


def conditional_normalize(
    df: DataFrame,
    image: str,
    class_id: str,
    class_table: DataFrame,
    channels: int,
    moving: DataFrame | None = None,
    output: str = "normalized",
    epsilon: float = EPSILON,
) -> DataFrame:
    """(x - mean) / sqrt(variance + eps) * gamma[class] + beta[class], per channel.

    Mean and variance are taken over all rows and positions, not per class. ``class_table`` holds
    (class_id, gamma, beta). ``moving`` (``channel``, ``mean``, ``variance``) replaces the moments of
    the input, as at inference.
    """
    moments = moving if moving is not None else channel_moments(df, image, channels)
    joined = lookup_class(df, class_id, class_table).withColumn("_stats", moments_as_arrays(moments))
    normalized = _normalize(F.col(image), F.col("_stats"), F.col("gamma"), F.col("beta"), channels, epsilon)
    return joined.withColumn(output, normalized).drop("_stats", "gamma", "beta")


def conditional_normalize_as_of(
    df: DataFrame,
    image: str,
    class_id: str,
    class_table: DataFrame,
    step: str,
    versions: DataFrame,
    channels: int,
    output: str = "normalized",
    epsilon: float = EPSILON,
) -> DataFrame:
    """``conditional_normalize`` with live moving statistics: each row takes the latest that are not after its ``step``.

    ``versions`` holds (``step``, ``channel``, ``moving_mean``, ``moving_variance``), as :func:`moments.moving_versions`
    gives it by channel. A version must have all channels. Rows before the first version are an error.
    """
    packed = versions.groupBy(F.col(step).alias("_version")).agg(
        F.sort_array(F.collect_list(F.struct("channel", F.col("moving_mean").alias("mean"), F.col("moving_variance").alias("variance")))).alias("_c")
    )
    whole = F.when(
        F.size("_c") != channels,
        F.raise_error(F.concat(F.lit("channels are missing in version "), F.col("_version").cast("string"))),
    )
    stats = F.struct(F.transform("_c", lambda c: c["mean"]).alias("mean"), F.transform("_c", lambda c: c["variance"]).alias("variance"))
    packed = packed.select("_version", F.coalesce(whole.cast(STATS), stats).alias("_stats"))
    joined = as_of(lookup_class(df, class_id, class_table), step, packed, "_version")
    early = F.raise_error(F.concat(F.lit("no statistics yet at step "), F.coalesce(F.col(step).cast("string"), F.lit("null"))))
    joined = joined.withColumn("_stats", F.coalesce("_stats", early.cast(STATS)))
    normalized = _normalize(F.col(image), F.col("_stats"), F.col("gamma"), F.col("beta"), channels, epsilon)
    return joined.withColumn(output, normalized).drop("_stats", "_version", "gamma", "beta")


def normalize(
    df: DataFrame,
    image: str,
    channels: int,
    gamma: Sequence[float] | None = None,
    beta: Sequence[float] | None = None,
    moving: DataFrame | None = None,
    output: str = "normalized",
    epsilon: float = EPSILON,
) -> DataFrame:
    """Normalisation without classes; gamma is 1 and beta 0 unless given."""
    moments = moving if moving is not None else channel_moments(df, image, channels)
    g = vector_literal(gamma if gamma is not None else [1.0] * channels)
    b = vector_literal(beta if beta is not None else [0.0] * channels)
    stats = df.withColumn("_stats", moments_as_arrays(moments))
    return stats.withColumn(output, _normalize(F.col(image), F.col("_stats"), g, b, channels, epsilon)).drop("_stats")


def projection_score(
    df: DataFrame,
    image: str,
    class_id: str,
    class_map: DataFrame,
    class_vector: str,
    weights: Sequence[float],
    bias: float = 0.0,
    output: str = "score",
) -> DataFrame:
    """w . h + b + h . e[class], where h sums relu(image) over positions per channel."""
    joined = lookup_class(df, class_id, class_map)
    pooled = joined.withColumn("_h", spatial_sum(F.col(image), len(weights), positive=True))
    h = F.col("_h")
    score = dot(h, vector_literal(weights)) + F.lit(float(bias)) + dot(h, F.col(class_vector))
    return pooled.withColumn(output, score).drop("_h", class_vector)
