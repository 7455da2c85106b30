"""Means, variances and covariances of vector columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..functions.arrays import doubles, whole_div
from .kernels import group_rows, vectors_to_matrix
from .ranking import estimated_bytes, ordered_rank


# What a task holds of partial results before it passes them on.
FOLD_BYTES = 256 << 20


# --- per channel and per position ----------------------------------------------------------------


# Rows of one key that are merged at a time: a task's parts, then those of groups of tasks, then of groups of those.
BRANCHES = (1024, 32, 1)


def position_moments(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, and mean and sum of squared deviations at each position, per key: (keys, n, mean, m2).

    Tasks fold their rows into two vectors per key. These merge exactly, in three levels of groups of tasks, so
    that no merge reads more than a few dozen vectors. Ragged and null vectors are errors.
    """
    keys = list(keys)
    schema = T.StructType([
        *[df.schema[k] for k in keys], T.StructField("branch", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("m2", T.ArrayType(T.DoubleType())),
    ])
    target = to_arrow_schema(schema)

    def add(held: dict, key: tuple, n: int, mean: np.ndarray, m2: np.ndarray) -> int:
        old = held.get(key)
        if old is None:
            held[key] = (n, mean, m2)
            return mean.nbytes + m2.nbytes
        if old[1].shape != mean.shape:
            raise ValueError("vectors of different lengths")
        total, gap = old[0] + n, mean - old[1]
        held[key] = (total, old[1] + gap * (n / total), old[2] + m2 + gap * gap * (old[0] * n / total))
        return 0

    def result(held: dict, branch: int) -> Iterator[pa.RecordBatch]:
        for key, part in held.items():
            values = [*key, branch, *part]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = TaskContext.get().partitionId()
        held: dict = {}
        held_bytes = 0
        for batch in batches:
            for key, index in group_rows(batch, len(keys)) if batch.num_rows else ():
                column = batch.column(len(keys))
                x = vectors_to_matrix(column if index is None else column.take(pa.array(index)))
                mean = x.mean(axis=0)
                held_bytes += add(held, key, len(x), mean, ((x - mean) ** 2).sum(axis=0))
                if held_bytes > FOLD_BYTES:
                    yield from result(held, branch)
                    held, held_bytes = {}, 0
        yield from result(held, branch)

    merged = df.select(*keys, doubles(F.col(vector)).alias("_x")).mapInArrow(fold, schema)
    for branches in BRANCHES:
        # The parts of a group of tasks; a single one is taken as it is.
        merged = merged.withColumn("branch", F.col("branch") % branches).groupBy(*keys, "branch").agg(F.collect_list(F.struct(*_PART)).alias("_parts"))
        whole = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get("_parts", F.lit(0)), _merge_parts)
        merged = merged.withColumn("_part", whole).select(*keys, "branch", *[F.col(f"_part.{c}").alias(c) for c in _PART])
    return merged.drop("branch")


_PART = ("n", "mean", "m2")


def _merge_parts(a: Column, b: Column) -> Column:
    """(n, mean, m2) of two disjoint row sets."""
    uneven = F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")
    n = a["n"] + b["n"]
    gap = F.when(F.size(a["mean"]) == F.size(b["mean"]), F.zip_with(b["mean"], a["mean"], lambda x, y: x - y)).otherwise(uneven)
    mean = F.zip_with(a["mean"], b["mean"], lambda x, y: x + (y - x) * (b["n"] / n))
    spread = F.zip_with(F.zip_with(a["m2"], b["m2"], lambda x, y: x + y), gap, lambda x, g: x + g * g * (a["n"] * b["n"] / n))
    return F.struct(n.alias("n"), mean.alias("mean"), spread.alias("m2"))


def _positions(df: DataFrame, vector: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n, pos, mean, m2): as many rows as a vector is long."""
    pairs = F.arrays_zip("mean", "m2")
    tall = position_moments(df, vector, keys).select(*keys, "n", F.posexplode(pairs).alias("pos", "_p"))
    return tall.select(*keys, "n", "pos", F.col("_p.mean").alias("mean"), F.col("_p.m2").alias("m2"))


def channel_moments(df: DataFrame, vector: str, channels: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population variance per channel over all rows and positions of flat images of one size."""
    tall = _positions(df, vector, keys).withColumn("channel", F.col("pos") % channels)
    # All positions have the same number of rows: the variance is that within positions and that of their means.
    return tall.groupBy(*keys, "channel").agg(
        F.avg("mean").alias("_mean"), (F.avg(F.col("m2") / F.col("n")) + F.var_pop("mean")).alias("variance")
    ).withColumnRenamed("_mean", "mean").select(*keys, "channel", "mean", "variance")


def batch_moments(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and variance over the rows at each position, then averaged over positions."""
    return _positions(df, vector, keys).groupBy(*keys).agg(
        F.avg("mean").alias("_mean"), F.avg(F.col("m2") / F.col("n")).alias("mean_variance")
    ).withColumnRenamed("_mean", "mean")


def moments_as_arrays(moments: DataFrame) -> Column:
    """Channel moments as one struct of arrays, a scalar subquery other rows can use.

    One row of 2 x channels numbers whatever the size of the data.
    """
    packed = moments.agg(F.array_sort(F.collect_list(F.struct("channel", "mean", "variance"))).alias("_all"))
    return packed.select(
        F.struct(
            F.transform("_all", lambda s: s["mean"]).alias("mean"),
            F.transform("_all", lambda s: s["variance"]).alias("variance"),
        )
    ).scalar()


def moving_moments(
    batches: DataFrame,
    batch: str,
    keys: Sequence[str],
    decay: float = 0.999,
    initial_mean: float = 0.0,
    initial_variance: float = 1.0,
    state: DataFrame | None = None,
) -> DataFrame:
    """Exponential moving mean and variance after one update per batch, in batch order.

    ``batches`` holds ``mean`` and ``variance`` per (keys, batch). The sequential update
    m <- m*d + x*(1-d) unrolls to a weighted sum, so it is an ordinary aggregate. ``state``, an earlier
    result, is carried on from instead of the initial values.
    """
    ranked = ordered_rank(batches, batch, group=keys, rank="_t", total="_n")
    weight = (1 - decay) * F.pow(F.lit(decay), F.col("_n") - 1 - F.col("_t"))
    sums = ranked.groupBy(*keys).agg(
        F.sum(weight * F.col("mean")).alias("_mean"),
        F.sum(weight * F.col("variance")).alias("_variance"),
        F.max("_n").alias("_n"),
    )
    if state is None:
        sums = sums.withColumns({
            "moving_mean": F.lit(initial_mean), "moving_variance": F.lit(initial_variance), "batches": F.lit(0),
        })
    else:
        sums = state.join(sums, list(keys), "full")
    carried = F.pow(F.lit(decay), F.coalesce(F.col("_n"), F.lit(0)))

    def moved(before: str, initial: float, update: str):
        return (carried * F.coalesce(F.col(before), F.lit(initial)) + F.coalesce(F.col(update), F.lit(0.0))).alias(before)

    return sums.select(
        *keys,
        moved("moving_mean", initial_mean, "_mean"),
        moved("moving_variance", initial_variance, "_variance"),
        (F.coalesce(F.col("batches"), F.lit(0)) + F.coalesce(F.col("_n"), F.lit(0))).cast("bigint").alias("batches"),
    )


def moving_versions(
    batches: DataFrame,
    batch: str,
    keys: Sequence[str],
    decay: float = 0.999,
    initial_mean: float = 0.0,
    initial_variance: float = 1.0,
) -> DataFrame:
    """Moving mean and variance after each batch, that is, all versions of the state: (keys, batch, moving_mean, moving_variance).

    Input as for :func:`moving_moments`. The updates of a key are cut into chunks of consecutive batches. Inside a
    chunk the state is a running sum of weighted updates; what a chunk carries over to the next is one number, and
    those of a key are folded in order. No window sees more than a chunk.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    chunk = max(1, min(1024, int(100 / -math.log10(decay))))  # weights stay within 10**100
    values = {"moving_mean": ("mean", initial_mean), "moving_variance": ("variance", initial_variance)}
    ranked = ordered_rank(batches, batch, group=keys, rank="_t")
    ranked = ranked.withColumn("_chunk", whole_div(F.col("_t"), chunk)).withColumn("_in", F.col("_t") % chunk)
    upto = Window.partitionBy(*keys, "_chunk").orderBy("_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, (column, _) in values.items():
        grown = F.sum(F.col(column) * F.pow(F.lit(1 / decay), F.col("_in"))).over(upto)
        ranked = ranked.withColumn(f"_{name}", (1 - decay) * grown * F.pow(F.lit(decay), F.col("_in")))

    # What a chunk adds by its end, and its length; the state before each chunk follows from those before it.
    last = [F.max_by(f"_{name}", "_in").alias(name) for name in values]
    chunks = ranked.groupBy(*keys, "_chunk").agg((F.max("_in") + 1).alias("n"), *last)
    listed = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", "n", *values))).alias("_all"))

    def carried(name: str, initial: float):
        def add(states, c):
            return F.concat(states, F.array(F.element_at(states, -1) * F.pow(F.lit(decay), c["n"]) + c[name]))

        return F.aggregate(F.col("_all"), F.array(F.lit(float(initial))), add)

    starts = listed.select(*keys, "_all", *[carried(name, initial).alias(f"_s_{name}") for name, (_, initial) in values.items()])
    zipped = F.arrays_zip(F.transform("_all", lambda c: c["_chunk"]).alias("c"), *[f"_s_{name}" for name in values])
    starts = starts.select(*keys, F.explode(zipped).alias("z")).where("z.c IS NOT NULL")
    starts = starts.select(*keys, F.col("z.c").alias("_chunk"), *[F.col(f"z._s_{name}") for name in values])
    decayed = F.pow(F.lit(decay), F.col("_in") + 1)
    return ranked.join(starts, [*keys, "_chunk"]).select(
        *keys, batch, *[(F.col(f"_s_{name}") * decayed + F.col(f"_{name}")).alias(name) for name in values]
    )


# --- full covariance: mergeable tiles -----------------------------------------------------------
#
# A task folds its rows into (n, mean, centred cross products) and emits the matrix in square tiles.
# Tiles merge exactly by the pairwise update of Chan, Golub and LeVeque (1979), for large inputs in two levels: first
# within `fan_in` groups of tasks, then across them. While folding, a task holds FOLD_BYTES of matrices and
# one more; while merging, one tile.

TILE = 256
# Estimated size of an input whose parts are merged in one level.
ONE_LEVEL_BYTES = 1 << 30


def tile_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType([
        *fields,
        T.StructField("ti", T.IntegerType()),
        T.StructField("tj", T.IntegerType()),
        T.StructField("branch", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean_i", T.ArrayType(T.DoubleType())),
        T.StructField("mean_j", T.ArrayType(T.DoubleType())),
        T.StructField("cross", T.ArrayType(T.DoubleType())),
    ])


def _merge(a: tuple, b: tuple) -> tuple:
    """(n, mean_i, mean_j, cross) of two disjoint row sets, cross being centred products."""
    if a is None:
        return b
    n = a[0] + b[0]
    if a[1].shape != b[1].shape or a[2].shape != b[2].shape:
        raise ValueError("vectors of different lengths")
    di, dj = b[1] - a[1], b[2] - a[2]
    cross = a[3] + b[3]
    cross += np.outer(di, dj * (a[0] * b[0] / n))
    return n, a[1] + di * (b[0] / n), a[2] + dj * (b[0] / n), cross


def vector_moments(
    df: DataFrame, vector: str, keys: Sequence[str] = (), fan_in: int = 32, most_dims: int | None = None
) -> DataFrame:
    """Count, mean and centred cross products of a vector column per key, as tiles.

    Result rows can be stored and merged again with :func:`merge_moments`, so moments of appended data
    need only the new rows. With ``most_dims`` longer vectors are an error.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(vector).alias("_vector"))
    schema = tile_schema(df, keys)
    key_types = [df.schema[k].dataType for k in keys]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = TaskContext.get().partitionId() % fan_in
        held: dict[tuple, tuple] = {}
        held_bytes = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = vectors_to_matrix(batch.column(len(keys)))
            if most_dims is not None and matrix.shape[1] > most_dims:
                raise ValueError(f"vectors of length {matrix.shape[1]}, at most {most_dims} are allowed")
            for key, index in group_rows(batch, len(keys)):
                x = matrix if index is None else matrix[index]
                mean = x.mean(axis=0)
                x = x - mean
                new = key not in held
                held[key] = _merge(held.get(key), (len(x), mean, mean, x.T @ x))
                held_bytes += held[key][3].nbytes if new else 0
                # Asked after every key: one batch may bring any number of them.
                if held_bytes > FOLD_BYTES:
                    for done, part in held.items():
                        yield from emit(done, part, branch)
                    held, held_bytes = {}, 0
        for key, part in held.items():
            yield from emit(key, part, branch)

    def emit(key: tuple, part: tuple, branch: int) -> Iterator[pa.RecordBatch]:
        n, mean, _, cross = part
        starts = range(0, len(mean), TILE)
        for ti, i in enumerate(starts):
            for tj, j in enumerate(starts):
                if tj >= ti:
                    yield _tile_batch(
                        key, ti, tj, branch, (n, mean[i:i + TILE], mean[j:j + TILE], cross[i:i + TILE, j:j + TILE]),
                        keys, key_types,
                    )

    tiles = rows.mapInArrow(fold, schema)
    # The parts of a small input are few; only the speed depends on the estimate.
    if estimated_bytes(rows) > ONE_LEVEL_BYTES:
        tiles = _merge_tiles(tiles, keys, "branch", key_types)
    return _merge_tiles(tiles, keys, None, key_types)


def merge_moments(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Moments of the union of row sets from their moments."""
    keys = list(keys)
    return _merge_tiles(moments, keys, None, [moments.schema[k].dataType for k in keys])


def _tile_batch(key, ti, tj, branch, part, keys, key_types) -> pa.RecordBatch:
    n, mean_i, mean_j, cross = part
    vectors = pa.list_(pa.float64())
    columns = [pa.array([k], to_arrow_type(t)) for k, t in zip(key, key_types)]
    columns += [
        pa.array([ti], pa.int32()), pa.array([tj], pa.int32()), pa.array([branch], pa.int32()), pa.array([n], pa.int64()),
        pa.array([mean_i], vectors), pa.array([mean_j], vectors), pa.array([np.ravel(cross)], vectors),
    ]
    names = [*keys, "ti", "tj", "branch", "n", "mean_i", "mean_j", "cross"]
    return pa.RecordBatch.from_arrays(columns, names)


def _merge_tiles(tiles: DataFrame, keys: list[str], branch: str | None, key_types: list) -> DataFrame:
    by = [*keys, "ti", "tj", *([branch] if branch else [])]

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("n")[row].as_py()
                mean_i = batch.column("mean_i")[row].values.to_numpy()
                mean_j = batch.column("mean_j")[row].values.to_numpy()
                cross = batch.column("cross")[row].values.to_numpy().reshape(len(mean_i), len(mean_j))
                total = _merge(total, (n, mean_i, mean_j, cross))
        values = [k.as_py() for k in key]
        at = len(keys)
        yield _tile_batch(values[:at], values[at], values[at + 1], values[at + 2] if branch else 0, total, keys, key_types)

    return tiles.groupBy(*by).applyInArrow(merge, tiles.schema)


def means(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per key and position."""
    diagonal = moments.filter(F.col("ti") == F.col("tj"))
    tall = diagonal.select(*keys, "ti", F.posexplode("mean_i").alias("_p", "mean"))
    return tall.select(*keys, (F.col("ti") * TILE + F.col("_p")).alias("i"), "mean")


def covariances(moments: DataFrame, keys: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Covariance per key and pair of positions i <= j, divisor n - ddof."""
    width = F.size("mean_j")
    tall = moments.select(*keys, "ti", "tj", "n", width.alias("_w"), F.posexplode("cross").alias("_p", "_x"))
    out = tall.select(
        *keys,
        (F.col("ti") * TILE + whole_div(F.col("_p"), F.col("_w"))).cast("int").alias("i"),
        (F.col("tj") * TILE + F.col("_p") % F.col("_w")).cast("int").alias("j"),
        (F.col("_x") / F.nullif(F.col("n") - F.lit(ddof), F.lit(0))).alias("cov"),
    )
    return out.filter(F.col("i") <= F.col("j"))
