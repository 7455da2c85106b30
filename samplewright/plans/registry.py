"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Registers a function under its own name, with its SQL if SQL can express it."""

    def add(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison between engines; + 0.0 turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


# Every element of every embedding: (vec_id, label, j, v).
EMB = """emb AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS v
  FROM embeddings)"""


def sql_hash(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"
