"""Arrow-batch functions over ARRAY columns, and their conversion to and from NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())
FLOATS = T.ArrayType(T.FloatType())
INTS = T.ArrayType(T.IntegerType())


def arrow_kernel(return_type: T.DataType) -> Callable:
    """Decorator for a function from Arrow arrays to an Arrow array.

    Exploding a column makes Spark infer a filter on it and push that filter down; over a Python column
    this would run the function a second time. Declaring the function nondeterministic keeps it at one
    run per row. Filters do not move below it either, so filter first.
    """
    return lambda function: F.arrow_udf(function, return_type).asNondeterministic()


# Images are worked on in slices of this many values, whatever the size of the Arrow batch.
SLICE_VALUES = 4 << 20


def image_kernel(function: Callable[[np.ndarray], np.ndarray]):
    """Column function from a function of flat images (rows of a matrix) to one result per image.

    Results come back in slices, so a batch of large images never has all of its results, or all of
    the intermediate arrays, in memory at once.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for images in batches:
            values = max(1, len(images.flatten()) // max(1, len(images)))
            step = max(1, SLICE_VALUES // values)
            for start in range(0, len(images), step):
                out = function(vectors_to_matrix(images.slice(start, step)))
                yield matrix_to_vectors(out.reshape(len(out), -1))

    # Spark tells an iterator function from these names.
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_kernel(DOUBLES)(run)


def vectors_to_matrix(column: pa.Array) -> np.ndarray:
    """ARRAY column of equally long, complete vectors as a float64 matrix."""
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("null inside a vector")
    rows = len(column)
    size = len(flat) // rows if rows else 0
    if rows and np.any(np.diff(column.offsets.to_numpy()) != size):
        raise ValueError("ragged vectors")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(rows, size)


def matrix_to_vectors(matrix: np.ndarray, dtype: type = np.float64) -> pa.Array:
    """Rows of a matrix as an ARRAY column."""
    rows, size = matrix.shape
    if rows * size > np.iinfo(np.int32).max:
        raise ValueError("batch too large; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(size)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype).ravel()))


def group_rows(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray | None]]:
    """(key, row numbers) of a batch whose first columns are keys; no keys give one group of all rows."""
    if not n_keys:
        yield (), None
        return
    codes = np.zeros(batch.num_rows, np.int64)
    for i in range(n_keys):
        # Codes, not values: a pandas column of whole numbers with a null would round them to doubles.
        coded = batch.column(i).dictionary_encode(null_encoding="encode")
        pair = codes * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(pair, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for index in np.split(order, starts[1:]):
        yield tuple(batch.column(i)[int(index[0])].as_py() for i in range(n_keys)), index
