"""Matrices as tables (one row per matrix row) against vector columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..commits import CommitConflict, CommitLog
from ..functions.arrays import L2_EPSILON, dot, doubles, l2_normalize, map_with, vector_literal, whole_div
from ..functions.hashing import normal_vector
from ..session import store
from .kernels import DOUBLES, arrow_kernel, group_rows, matrix_to_vectors, vectors_to_matrix
from .moments import FOLD_BYTES

# Largest matrix handed to every task: 64 MB. Larger ones go through `project_by_join`.
MAX_SHIPPED_CELLS = 8_000_000


def pack(rows: DataFrame, position: str, value: str) -> Column:
    """A (position, value) table as one array, usable as a scalar in another query.

    For tables with one row per vector position only.
    """
    packed = rows.agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("_all"))
    return packed.select(F.transform("_all", lambda s: s[value])).scalar()


# --- linear projection ---------------------------------------------------------------------------


def linear_project(
    df: DataFrame, vector: str, weights: DataFrame, output: str, bias: Sequence[float] | None = None
) -> DataFrame:
    """Adds x . W (+ b), W given as rows (``row``, ``w``) with ``row`` running from 0.

    W is shipped to the tasks when its size allows; the rows of ``df`` are not shuffled.
    """
    shape = weights.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w")).alias("width")).first()
    if shape.n == 0:
        raise ValueError("empty weight matrix")
    if shape.n * shape.width > MAX_SHIPPED_CELLS:
        raise ValueError(f"{shape.n} x {shape.width} weights are too many to ship; use project_by_join")
    matrix = np.array([r.w for r in weights.orderBy("row").select("w").collect()], dtype=np.float64)
    return df.withColumn(output, project(F.col(vector), matrix, bias))


def project(vector: Column, matrix: np.ndarray, bias: Sequence[float] | None = None) -> Column:
    """x . W (+ b) for a small matrix; also a 1x1 convolution when applied per pixel."""
    shift = np.zeros(matrix.shape[1]) if bias is None else np.asarray(bias, dtype=np.float64)

    @arrow_kernel(DOUBLES)
    def multiply(x: pa.Array) -> pa.Array:
        return matrix_to_vectors(vectors_to_matrix(x) @ matrix + shift if len(x) else np.empty((0, matrix.shape[1])))

    return multiply(doubles(vector))


# Columns and rows of a matrix that one tile holds.
TILE_COLUMNS, TILE_ROWS = 1024, 4096


def project_by_join(
    df: DataFrame, row_id: str, vector: str, weights: DataFrame, output: str, bias: DataFrame | None = None
) -> DataFrame:
    """x . W (+ b) for a matrix of any size, as (row_id, output); ``row_id`` is unique.

    W is cut into tiles that are joined with the vectors' slices; a task multiplies Arrow batches of
    slices by a tile, and the products are added up per vector. W is ``row`` from 0 and ``w``; ``bias`` holds
    (``pos``, ``b``), 0 where a position is missing. Vectors that are not as long as W has rows, ragged or
    missing rows of W, and positions off the output are errors.
    """
    shape = weights.agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max("row").alias("last"),
        F.count_distinct("row").alias("distinct"), F.min(F.size("w")).alias("short"), F.max(F.size("w")).alias("width"),
    ).first()
    if not shape.n:
        raise ValueError("empty weight matrix")
    if (shape.first, shape.last, shape.distinct) != (0, shape.n - 1, shape.n):
        raise ValueError("matrix rows must be numbered from 0 without gaps")
    if shape.short != shape.width:
        raise ValueError("ragged weight matrix")
    height, width = shape.n, shape.width

    length = F.size(vector)
    fault = F.raise_error(F.concat(F.lit(f"vector against {height} matrix rows: "), F.coalesce(length.cast("string"), F.lit("null"))))
    checked = F.when(length == height, doubles(F.col(vector))).otherwise(fault.cast("array<double>"))
    bands = F.sequence(F.lit(0), F.lit((height - 1) // TILE_ROWS))
    slices = df.select(F.col(row_id).alias("_id"), checked.alias("_x")).select("_id", "_x", F.explode(bands).alias("_band"))
    slices = slices.select("_id", "_band", F.slice("_x", F.col("_band") * TILE_ROWS + 1, TILE_ROWS).alias("_x"))

    spans = F.sequence(F.lit(0), F.lit((width - 1) // TILE_COLUMNS))
    cut = weights.select(F.col("row"), doubles(F.col("w")).alias("w"), F.explode(spans).alias("_span"))
    cut = cut.select(whole_div(F.col("row"), TILE_ROWS).alias("_of"), "_span", "row",
                     F.slice("w", F.col("_span") * TILE_COLUMNS + 1, TILE_COLUMNS).alias("_w"))
    tiles = cut.groupBy("_of", "_span").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row", "_w"))), lambda r: r["_w"])).alias("_tile"))
    # Slices travel once per column span; a task holds one tile at a time.
    met = slices.select("_id", "_band", "_x", F.explode(spans).alias("_at")).join(
        tiles, (F.col("_band") == F.col("_of")) & (F.col("_at") == F.col("_span")))

    schema = T.StructType([T.StructField("_id", df.schema[row_id].dataType), T.StructField("_span", T.IntegerType()), T.StructField("_part", DOUBLES)])
    target = to_arrow_schema(schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([batch.column(1).to_numpy(), batch.column(3).to_numpy()]) if batch.num_rows else np.empty((2, 0))
            edges = np.flatnonzero(np.any(np.diff(at, axis=1, prepend=-1) != 0, axis=0))
            for start, stop in zip(edges, [*edges[1:], batch.num_rows]):
                x = vectors_to_matrix(batch.column(2).slice(start, stop - start))
                tile = batch.column(4)[int(start)].values.to_numpy().reshape(x.shape[1], -1)
                columns = [batch.column(0).slice(start, stop - start), batch.column(3).slice(start, stop - start), matrix_to_vectors(x @ tile)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    products = met.select("_id", "_band", "_x", F.col("_at").cast("int").alias("_at"), "_tile").mapInArrow(multiply, schema)
    added = F.aggregate(F.slice("_parts", 2, F.size("_parts")), F.get("_parts", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    spans_of = products.groupBy("_id", "_span").agg(F.collect_list("_part").alias("_parts")).select("_id", "_span", added.alias("_part"))
    whole = spans_of.groupBy("_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_span", "_part"))), lambda s: s["_part"])).alias(output))
    if bias is not None:
        outside = F.raise_error(F.lit(f"bias position off [0, {width})")).cast("int")
        place = F.when(F.col("pos").between(0, width - 1), F.col("pos").cast("int")).otherwise(outside)
        entries = bias.agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("b").cast("double")))).alias("_b"))  # as long as the output
        shift = entries.select(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.element_at("_b", i), F.lit(0.0)))).scalar()
        whole = whole.withColumn("_shift", shift).withColumn(output, F.zip_with(output, "_shift", lambda x, b: x + b)).drop("_shift")
    return whole.select(F.col("_id").alias(row_id), output)


# --- dominant singular value ---------------------------------------------------------------------


def start_vector(size: int, seed: int = 0) -> Column:
    """Reproducible Gaussian start for the power iteration."""
    return normal_vector(seed, F.lit("u"), size)


def dominant_singular_value(
    matrix: DataFrame, weights: str, u: Column, num_iters: int = 1, eps: float = L2_EPSILON
) -> DataFrame:
    """One row (``u``, ``sigma``): power iteration on a matrix table, started at array ``u``.

    An iteration is one aggregation: each row forms v_i = w_i . u and adds (v_i * w_i, v_i^2), which is
    all that v W and |v| need. Only vectors as long as a matrix row move between iterations. Meant for
    few iterations per call; carry ``u`` over with :class:`SpectralState` for more.
    """
    if num_iters < 1:
        raise ValueError("num_iters must be at least 1")
    for left in reversed(range(num_iters)):
        step = _power_step(matrix, weights, u, eps)
        if left:
            u = step.select("u").scalar()
    return step


def _power_step(matrix: DataFrame, weights: str, u: Column, eps: float) -> DataFrame:
    rows = matrix.select(doubles(F.col(weights)).alias("_w"), doubles(u).alias("_u"))
    folded = _folded_products(rows)
    total = F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    # One row for each branch, of a length that is a matrix row's.
    packed = folded.agg(F.collect_list("_vw").alias("_all"), F.sqrt(F.sum("_vv")).alias("_norm"))
    vw = packed.select(map_with(total, F.col("_norm"), lambda x, n: x / (n + eps)).alias("_vw"))
    return vw.withColumn("u", l2_normalize(F.col("_vw"), eps)).select("u", dot(F.col("_vw"), F.col("u")).alias("sigma"))


def _folded_products(rows: DataFrame, branches: int = 32) -> DataFrame:
    """Sums of v w and v v over rows (_w, _u) with v = w . u: one row for each branch."""

    def result(branch: int, vw: np.ndarray, vv: float) -> pa.RecordBatch:
        columns = [pa.array([branch], pa.int32()), pa.array([vw], pa.list_(pa.float64())), pa.array([vv], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["_branch", "_vw", "_vv"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vw, vv = None, 0.0
        for batch in batches:
            if batch.num_rows:
                w = vectors_to_matrix(batch.column(0))
                u = batch.column(1)[0].values.to_numpy()
                if len(u) != w.shape[1]:
                    raise ValueError(f"vectors of different lengths: {len(u)} against {w.shape[1]}")
                v = w @ u
                vw, vv = v @ w if vw is None else vw + v @ w, vv + float(v @ v)
        if vw is not None:
            yield result(TaskContext.get().partitionId() % branches, vw, vv)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vw, vv = None, 0.0
        for batch in batches:
            for part, square in zip(batch.column("_vw"), batch.column("_vv").to_pylist()):
                x = part.values.to_numpy()
                vw, vv = x if vw is None else vw + x, vv + square
        yield result(key[0].as_py(), vw, vv)

    schema = "_branch int, _vw array<double>, _vv double"
    return rows.mapInArrow(fold, schema).groupBy("_branch").applyInArrow(merge, schema)


def divide_by(df: DataFrame, weights: str, sigma: Column) -> DataFrame:
    """Every element of a vector column divided by a scalar (a column or scalar subquery)."""
    # A scalar subquery may not stand inside a lambda, so it becomes a column first.
    scaled = map_with(doubles(F.col(weights)), F.col("_divisor"), lambda x, s: x / s)
    return df.withColumn("_divisor", sigma).withColumn(weights, scaled).drop("_divisor")


def spectral_normalize(
    matrix: DataFrame, weights: str, u: Column, num_iters: int = 1, eps: float = L2_EPSILON
) -> DataFrame:
    """The matrix divided by its dominant singular value."""
    sigma = dominant_singular_value(matrix, weights, u, num_iters, eps).select("sigma").scalar()
    return divide_by(matrix, weights, sigma)


def rescale_map(class_map: DataFrame, vector: str, u: str, num_iters: int = 1, eps: float = L2_EPSILON) -> DataFrame:
    """A class-to-vector map divided by the dominant singular value of its transpose.

    The map's rows are the columns of the matrix iterated on, so ``u`` is a column of the map; it is
    brought up to date and ``sigma`` added.
    """
    if num_iters < 1:
        raise ValueError("num_iters must be at least 1")
    rows = class_map.withColumn(u, F.col(u).cast("double"))
    # The iteration runs on the class table's rows; each step needs the step before twice, so its new
    # column is written out and read again, and the plan of a step doesn't hold the steps before.
    for _ in range(num_iters):
        scaled = rows.select(map_with(doubles(F.col(vector)), F.col(u), lambda x, c: x * c).alias("_x"))
        parts = _folded_sums(scaled, [], "_x")
        total = F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        v = parts.agg(F.collect_list("_sum").alias("_all")).select(l2_normalize(total, eps)).scalar()
        rows = rows.withColumn("_v", v)
        rows = store(rows.withColumn("_p", dot(F.col(vector), F.col("_v"))).drop("_v"), "rescale-map")
        norm = rows.agg(F.sqrt(F.sum(F.col("_p") * F.col("_p")))).scalar()
        rows = rows.withColumn("_norm", norm).withColumn(u, F.col("_p") / (F.col("_norm") + eps))
        rows = rows.withColumn("sigma", F.col("_norm") * F.col("_norm") / (F.col("_norm") + eps)).drop("_p", "_norm")
    return divide_by(rows, vector, F.col("sigma"))


class SpectralState:
    """``u`` kept between calls in a state table, one version for each commit.

    Modes: 'update' stores the new u, 'frozen' leaves the stored one alone, 'deferred' hands the new u
    to the caller, who stores it with :meth:`commit`. A version can be stored once: a writer that goes on from a
    version which another writer has followed gets a CommitConflict, and starts again from :meth:`refresh`.
    """

    def __init__(self, spark: SparkSession, path: str, size: int, seed: int = 0, start: Sequence[float] | None = None):
        self.spark, self.log = spark, CommitLog(spark, path)
        self.version = self.log.newest()
        if self.version < 0:
            first = spark.range(1).select(start_vector(size, seed)).first()[0] if start is None else start
            try:
                self.commit(first)
            except CommitConflict:  # another writer has begun, with the same vector
                self.refresh()

    def refresh(self) -> int:
        """Goes on from the newest version."""
        self.version = self.log.newest()
        return self.version

    def current(self) -> list[float]:
        """The u of the version that this writer goes on from."""
        return self.log.read(self.version)["u"]

    def commit(self, u: Sequence[float]) -> None:
        """Stores u as the version after the one that was read."""
        self.log.commit(self.version + 1, {"u": [float(x) for x in u]})
        self.version += 1

    def table(self) -> DataFrame:
        """All versions: (version, u)."""
        rows = [(v, self.log.read(v)["u"]) for v in range(self.log.newest() + 1)]
        return self.spark.createDataFrame(rows, "version int, u array<double>")

    def step(self, matrix: DataFrame, weights: str, num_iters: int = 1, mode: str = "update") -> tuple[float, list[float]]:
        """(sigma, new u) for the matrix as it is now."""
        if mode not in ("update", "frozen", "deferred"):
            raise ValueError(f"unknown mode {mode!r}")
        result = dominant_singular_value(matrix, weights, vector_literal(self.current()), num_iters).first()
        if mode == "update":
            self.commit(result.u)
        return result.sigma, result.u


# --- mean of aligned vectors ---------------------------------------------------------------------


def aligned_vector_mean(df: DataFrame, name: str, vector: str, contributors: int | None = None) -> DataFrame:
    """Element-wise mean over all rows of a name: (name, contributors, mean).

    Vectors of a name must agree in length, and with ``contributors`` a name must have that many rows;
    either mismatch is an error, and so are null and empty vectors. A task folds its rows into one sum
    per name.
    """
    sums = _folded_sums(df.select(name, F.col(vector).alias("_x")), [name], "_x")
    added = F.aggregate(F.slice("_sums", 2, F.size("_sums")), F.get("_sums", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    whole = sums.groupBy(name).agg(
        F.collect_list("_sum").alias("_sums"),  # one for each task that has rows of the name, and FOLD_BYTES of others
        F.sum("_n").alias("contributors"),
        F.min(F.size("_sum")).alias("_short"),
        F.max(F.size("_sum")).alias("_long"),
    )
    fine = F.col("_short") == F.col("_long")
    if contributors is not None:
        fine = fine & (F.col("contributors") == contributors)
    fault = F.raise_error(F.concat(F.lit("vectors do not line up for "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))
    total = F.when(fine, added).otherwise(fault.cast("array<double>"))
    return whole.select(name, "contributors", map_with(total, F.col("contributors"), lambda x, n: x / n).alias("mean"))


def _folded_sums(df: DataFrame, keys: Sequence[str], vector: str, branches: int = 32) -> DataFrame:
    """Sums of a vector column per key, in at most ``branches`` rows of a key: (keys, _n, _sum).

    Tasks fold Arrow batches; what they emit is added up once more per key and branch.
    """
    keys = list(keys)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_branch", T.IntegerType()),
                           T.StructField("_n", T.LongType()), T.StructField("_sum", DOUBLES)])
    target = to_arrow_schema(schema)

    def batch_of(branch: int, held: dict[tuple, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for key, (n, total) in held.items():
            values = [*key, branch, n, total]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

    def add(held: dict, key: tuple, n: int, total: np.ndarray) -> int:
        old = held.get(key)
        if old is not None and old[1].shape != total.shape:
            raise ValueError(f"vectors do not line up for {key[0] if key else 'the table'}")
        held[key] = (n, total) if old is None else (old[0] + n, old[1] + total)
        return total.nbytes if old is None else 0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch = TaskContext.get().partitionId() % branches
        held: dict = {}
        held_bytes = 0
        for batch in batches:
            column = batch.column(len(keys))
            for key, index in group_rows(batch, len(keys)) if batch.num_rows else ():
                rows = vectors_to_matrix(column if index is None else column.take(pa.array(index)))
                if not rows.shape[1]:
                    raise ValueError("empty vector")
                held_bytes += add(held, key, len(rows), rows.sum(axis=0))
                if held_bytes > FOLD_BYTES:
                    yield from batch_of(branch, held)
                    held, held_bytes = {}, 0
        yield from batch_of(branch, held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        values = tuple(k.as_py() for k in key)
        for batch in batches:
            for n, total in zip(batch.column("_n").to_pylist(), batch.column("_sum")):
                add(held, values[:-1], n, total.values.to_numpy())
        yield from batch_of(values[-1], held)

    return df.select(*keys, doubles(F.col(vector)).alias("_x")).mapInArrow(fold, schema).groupBy(*keys, "_branch").applyInArrow(merge, schema)
