"""Running a user's model over a table in batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .generate import with_noise, with_uniform_class


def score(
    df: DataFrame,
    make_model: Callable[[], Callable],
    inputs: Mapping[str, int],
    outputs: Sequence[str],
    batch_size: int = 100,
) -> DataFrame:
    """Adds one ARRAY<DOUBLE> column per model output.

    ``make_model`` builds the model once per Python worker and returns a function from batch arrays
    (one per input, shape (rows, length), or (rows,) for length 0) to a dict of output matrices. Rows
    stream through; no batch is kept.
    """
    fields = T.StructType([T.StructField(name, T.ArrayType(T.DoubleType())) for name in outputs])
    shapes = {at: [size] for at, size in enumerate(inputs.values()) if size}
    model = predict_batch_udf(
        make_model, return_type=fields, batch_size=batch_size, input_tensor_shapes=shapes or None
    ).asNondeterministic()  # one run per row, see kernels.arrow_kernel
    scored = df.withColumn("_out", model(*[F.col(name) for name in inputs]))
    return scored.select(*df.columns, *[F.col(f"_out.{name}").alias(name) for name in outputs])


def generate_samples(
    rows: DataFrame,
    row: str,
    make_generator: Callable[[], Callable],
    z_dim: int,
    num_classes: int,
    outputs: Sequence[str],
    seed: int = 0,
    batch_size: int = 100,
) -> DataFrame:
    """One generated sample per row id: noise and a uniform class, through the user's generator.

    Both inputs are functions of (seed, row), so a retried task makes the same samples.
    """
    latent = with_uniform_class(with_noise(rows.select(row), row, z_dim, seed), row, num_classes, seed)
    return score(latent, make_generator, {"z": z_dim, "class_id": 0}, outputs, batch_size)
