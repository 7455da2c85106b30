"""Checks on tables: vector shapes, and names that must fall under exactly one prefix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_report(df: DataFrame, vector: str, size: int, rows: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: rows, shortest and longest vector, incomplete vectors, and whether all is as expected."""
    length = F.coalesce(F.size(vector), F.lit(-1))
    bad = F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    report = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(length).alias("shortest"),
        F.max(length).alias("longest"),
        F.count_if(bad).alias("incomplete"),
    )
    fine = (F.col("shortest") == size) & (F.col("longest") == size) & (F.col("incomplete") == 0)
    if rows is not None:
        fine = fine & (F.col("rows") == rows)
    return report.withColumn("ok", F.coalesce(fine, F.lit(rows == 0)))


def require_shape(df: DataFrame, vector: str, size: int) -> DataFrame:
    """The same rows; a vector of another length is an error when it is read."""
    found = F.coalesce(F.size(vector).cast("string"), F.lit("null"))
    fault = F.raise_error(F.concat(F.lit(f"expected length {size}, found "), found))
    return df.filter(F.when(F.size(vector) == size, True).otherwise(fault.cast("boolean")))


def prefix_split(df: DataFrame, name: str, prefixes: Mapping[str, str], tag: str | None = None) -> DataFrame:
    """Adds ``part`` (the rule a name falls under), ``matches`` and, with ``tag``, ``tagged``.

    Names must match one prefix and no more; :func:`split_violations` lists the others.
    """
    hits = [F.col(name).startswith(prefix) for prefix in prefixes.values()]
    part = F.coalesce(*[F.when(hit, F.lit(rule)) for rule, hit in zip(prefixes, hits)])
    matches = sum((hit.cast("int") for hit in hits), F.lit(0))
    out = df.withColumn("matches", matches).withColumn("part", F.when(F.col("matches") == 1, part))
    return out.withColumn("tagged", F.col(name).contains(tag)) if tag else out


def split_violations(split: DataFrame) -> DataFrame:
    """Rows under no prefix or under several."""
    return split.filter(F.coalesce(F.col("matches"), F.lit(0)) != 1)
