"""Noise, class draws and latent sweeps, one set per row of a given table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.arrays import required, single_entry
from ..functions.hashing import WORD, hash_word, normal_vector, uniform_int
from .ranking import ordered_rank


#: Shares that a table of class weights is cut into.
SHARES = 256


def with_noise(df: DataFrame, row: str, z_dim: int, seed: int, column: str = "z") -> DataFrame:
    """N(0,1) vector per row id."""
    return df.withColumn(column, normal_vector(seed, F.col(row), z_dim))


def with_uniform_class(df: DataFrame, row: str, num_classes: int, seed: int, column: str = "class_id") -> DataFrame:
    """Class drawn uniformly from [0, num_classes) per row id."""
    return df.withColumn(column, uniform_int(hash_word(seed, "class", F.col(row)), num_classes))


def with_weighted_class(
    df: DataFrame, row: str, weights: DataFrame, seed: int, column: str = "class_id", cells: int = 1024
) -> DataFrame:
    """Class drawn with probability proportional to ``weights(class_id, weight)``, weights >= 0.

    Null row ids, negative or null weights, and weights that add up to nothing are errors. Rows are never lost.

    [0, 1) is cut into cells and each class interval listed under the cells it touches, so a draw
    finds its class by an equality join on the cell, not by comparing with every class. Cells are hit
    evenly because draws are uniform. The running sums that bound the intervals are taken in shares of the class
    table in the order of classes, and offset by the sums of the shares before: tables of any size will do.
    """
    fault = F.raise_error(F.concat(F.lit("weight below 0 or missing: "), F.col("class_id").cast("string"))).cast("double")
    weights = weights.withColumn("weight", F.when(F.col("weight") >= 0, F.col("weight").cast("double")).otherwise(fault))
    cuts = weights.select(F.col("class_id").cast("double").alias("_at")).approxQuantile("_at", [i / SHARES for i in range(1, SHARES)], 1 / (4 * SHARES))
    limits = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    weights = weights.withColumn("_share", F.size(F.filter(limits, lambda c: c < F.col("class_id"))))
    sums = weights.groupBy("_share").agg(F.sum("weight").alias("weight")).orderBy("_share").collect()  # at most SHARES rows
    total, before = sum(r.weight for r in sums), {}
    for i, r in enumerate(sums):
        before[r._share] = sum(x.weight for x in sums[:i])
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_share")) if before else F.lit(0.0)
    in_share = Window.partitionBy("_share").orderBy("class_id")
    upto = F.sum("weight").over(in_share.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = weights.withColumn("_start", start).withColumn("_upto", upto)
    below = F.coalesce(F.lag("_upto").over(in_share), F.lit(0.0))
    whole = F.lit(float(total))
    bounds = bounds.withColumn("_lo", (F.col("_start") + below) / whole).withColumn("_hi", (F.col("_start") + F.col("_upto")) / whole)
    bounds = bounds.select(F.col("class_id").alias(column), "_lo", "_hi")
    intervals = bounds.filter(F.col("_lo") < F.col("_hi")).withColumn(
        "_cell",
        F.explode(F.sequence(F.floor(F.col("_lo") * cells), F.least(F.floor(F.col("_hi") * cells), F.lit(cells - 1)))),
    )
    u = hash_word(seed, "class", required(F.col(row), row)) / F.lit(float(WORD))
    drawn = df.withColumn("_u", u).withColumn("_cell", F.floor(F.col("_u") * cells))
    inside = (F.col("_lo") <= F.col("_u")) & (F.col("_u") < F.col("_hi"))
    intervals = intervals.withColumnRenamed("_cell", "_of")
    hit = drawn.join(intervals, (F.col("_cell") == F.col("_of")) & inside, "left")
    found = F.coalesce(F.col(column), F.raise_error(F.lit("no class has a weight above 0")).cast(bounds.schema[column].dataType))
    return hit.withColumn(column, found).drop("_cell", "_of", "_u", "_lo", "_hi")


def latent_traversal(df: DataFrame, row: str, z_dim: int, dims: int) -> DataFrame:
    """For each of the first ``dims`` latent dimensions, a sweep with one step per row.

    Step k of B (rows in order of ``row``) is the zero vector with k/B in the swept dimension. Columns:
    ``dim``, ``step``, ``value``, ``z``.
    """
    if dims > z_dim:
        raise ValueError(f"{dims} dimensions to sweep, vectors have {z_dim}")
    ranked = ordered_rank(df.select(row), row, rank="step", total="_steps")
    swept = ranked.select(
        row,
        F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"),
        "step",
        (F.col("step") / F.col("_steps")).alias("value"),
    )
    # The vectors are far larger than these rows. A stated number of partitions isn't merged by size, so
    # the tasks that make the vectors follow the session's parallelism.
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    swept = swept.repartition(tasks, "dim", "step")
    return swept.withColumn("z", single_entry(F.col("dim"), F.col("value"), z_dim))
