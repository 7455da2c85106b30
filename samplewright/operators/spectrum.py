"""Singular values of a tall matrix whose rows are the rows of a table.

The power iteration of ``linalg`` brings one vector a little nearer for each pass over the data, and hardly moves on
data that is alike in all directions. Here the values come out to full precision: up to ``QR_DIMS`` columns from one
pass, beyond that from Lanczos iterations over blocks of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import doubles
from .kernels import vectors_to_matrix

#: Columns up to which a task holds triangular factors: three of 32 MB at this width.
QR_DIMS = 2048
_PART = "branch int, part binary"


def _row(branch: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([branch], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["branch", "part"])


def triangular_factor(matrix: DataFrame, weights: str, dims: int, branches: int = 32) -> DataFrame:
    """R of a QR decomposition of the whole matrix, as one row (branch, part): ``dims`` x ``dims`` doubles.

    A tree of decompositions: tasks fold their rows into a factor, block by block, factors are folded within branches
    of tasks, and those of the branches in the end. No task holds more than a factor and a block of rows.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = vectors_to_matrix(batch.column(0))
            if rows.shape[1] != dims:
                raise ValueError(f"vectors of different lengths: {rows.shape[1]} against {dims}")
            for start in range(0, len(rows), max(1, dims)):
                waiting.append(rows[start : start + max(1, dims)])
                n += len(waiting[-1])
                if n >= 4 * dims:
                    held, waiting, n = _factor([held, *waiting]), [], 0
        if n:
            held = _factor([held, *waiting])
        if held is not None:
            yield _row(TaskContext.get().partitionId() % branches, held)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in batch.column("part"):
                held = _factor([held, np.frombuffer(part.as_py()).reshape(-1, dims)])
        yield _row(key[0].as_py(), held)

    folded = matrix.select(doubles(F.col(weights)).alias("_w")).mapInArrow(fold, _PART)
    within = folded.groupBy("branch").applyInArrow(merge, _PART)
    return within.withColumn("branch", F.lit(0)).groupBy("branch").applyInArrow(merge, _PART)


def _factor(parts: list[np.ndarray | None]) -> np.ndarray:
    return np.linalg.qr(np.concatenate([p for p in parts if p is not None]), mode="r")


def _gram_times(matrix: DataFrame, weights: str, block: np.ndarray, branches: int = 32) -> np.ndarray:
    """W^T W V for a block V of vectors: one pass, in which only blocks of that size move."""
    spark, shape = matrix.sparkSession, block.shape
    shared = spark.sparkContext.broadcast(block)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = shared.value, None
        for batch in batches:
            if batch.num_rows:
                rows = vectors_to_matrix(batch.column(0))
                if rows.shape[1] != len(v):
                    raise ValueError(f"vectors of different lengths: {rows.shape[1]} against {len(v)}")
                part = rows.T @ (rows @ v)
                total = part if total is None else total + part
        if total is not None:
            yield _row(TaskContext.get().partitionId() % branches, total)

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column("part"):
                value = np.frombuffer(part.as_py())
                total = value if total is None else total + value
        yield _row(key[0].as_py(), total)

    folded = matrix.select(doubles(F.col(weights)).alias("_w")).mapInArrow(fold, _PART)
    sums = folded.groupBy("branch").applyInArrow(merge, _PART).collect()  # a block of vectors for each branch
    shared.unpersist()
    return sum((np.frombuffer(r.part).reshape(shape) for r in sums), np.zeros(shape))


def lanczos(
    matrix: DataFrame, weights: str, dims: int, k: int, block: int = 16, passes: int = 30, tolerance: float = 1e-9, seed: int = 0
) -> tuple[np.ndarray, int]:
    """(the ``k`` largest singular values, passes used) by block Lanczos iterations on W^T W.

    Each pass multiplies a block of vectors and makes the result orthogonal to all vectors before, which the driver
    holds: ``dims`` x (``block`` x ``passes``) numbers at most. It ends when the residuals of the first ``k`` values are
    below ``tolerance`` times the largest one, or when the vectors span the whole space; that is an error if it
    takes more than ``passes``.
    """
    block = min(max(block, k), dims)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.normal(size=(dims, block)))[0]
    images = np.zeros((dims, 0))
    for used in range(1, passes + 1):
        images = np.concatenate([images, _gram_times(matrix, weights, basis[:, images.shape[1] :])], axis=1)
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        away = np.linalg.norm(images @ vectors - basis @ (vectors * values), axis=0)
        if basis.shape[1] >= dims or (len(values) == min(k, dims) and (away <= tolerance * max(values[0], 1e-300)).all()):
            return np.sqrt(np.clip(values, 0, None)), used
        fresh = images[:, -block:]
        for _ in range(2):  # twice, since once leaves rounding errors of the first time
            fresh = fresh - basis @ (basis.T @ fresh)
        q, r = np.linalg.qr(fresh)
        kept = np.abs(np.diag(r)) > 1e-12 * max(values[0], 1e-300)
        if not kept.any():  # the vectors span all that the matrix reaches
            return np.sqrt(np.clip(values, 0, None)), used
        q = q[:, kept][:, : dims - basis.shape[1]]
        basis, block = np.concatenate([basis, q], axis=1), q.shape[1]
    raise ValueError(f"{passes} passes are not enough for {k} values to a tolerance of {tolerance}")


def singular_values(matrix: DataFrame, weights: str, k: int | None = None, passes: int = 30, qr_dims: int = QR_DIMS) -> DataFrame:
    """The largest singular values of a matrix table: (place, value), place counting from 0; all of them without ``k``.

    Rows that are null or of different lengths are an error. An empty table gives none. Matrices of more than ``qr_dims``
    columns need a ``k`` (``lanczos``).
    """
    spark = matrix.sparkSession
    first = matrix.select(F.size(weights).alias("n")).first()
    if first is None:
        return spark.createDataFrame([], "place int, value double")
    dims = first.n
    if dims > qr_dims:
        if k is None:
            raise ValueError(f"name the number of values for more than {qr_dims} columns")
        values = lanczos(matrix, weights, dims, k, passes=passes)[0]
        return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "place int, value double")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part"):
                values = np.linalg.svd(np.frombuffer(part.as_py()).reshape(-1, dims), compute_uv=False)
                values = values[: len(values) if k is None else k]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["place", "value"])

    return triangular_factor(matrix, weights, dims).mapInArrow(finish, "place int, value double")
