"""Expressions over scalars and ARRAY columns (one array = one vector or one flat image).

Images are flat, row-major (y, x, channel): position = (y * width + x) * channels + channel.
Arithmetic is done in DOUBLE whatever the element type of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

L2_EPSILON = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body``.

    ``body`` must not use it inside a further lambda: Spark cannot pass an expression whose inner
    lambda uses an outer lambda's variable to a Python function. :func:`map_with` does that instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_with(vector: Column, shared: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(element, shared)`` for every element, ``shared`` being evaluated once per row.

    Written into the lambda itself it would be evaluated for every element.
    """
    return F.zip_with(vector, F.array_repeat(shared, F.size(vector)), fn)


def whole_div(a: Column, n: int | Column) -> Column:
    """Integer quotient."""
    return F.call_function("div", a, n if isinstance(n, Column) else F.lit(n))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# --- activations on scalars ---------------------------------------------------------------------


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def lrelu(x: Column, leak: float = 0.2) -> Column:
    return x * (0.5 * (1 + leak)) + F.abs(x) * (0.5 * (1 - leak))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


# --- vectors ------------------------------------------------------------------------------------


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def same_size(a: Column, b: Column) -> Column:
    """``a``, provided that it is as long as ``b``; another length is an error, a null stays null."""
    sizes = F.concat(F.size(a).cast("string"), F.lit(" against "), F.size(b).cast("string"))
    fault = F.raise_error(F.concat(F.lit("vectors of different lengths: "), sizes)).cast("array<double>")
    return F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), a).otherwise(fault)


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths are an error."""
    return vector_sum(F.zip_with(same_size(doubles(a), b), doubles(b), lambda x, y: x * y))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(vector: Column, eps: float = L2_EPSILON) -> Column:
    """v / (|v| + eps): eps stands outside the root, so a zero vector stays zero."""
    return let(doubles(vector), lambda v: map_with(v, l2_norm(v) + eps, lambda x, n: x / n))


def _log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.log(vector_sum(map_with(v, top, lambda x, m: F.exp(x - m))))


def log_softmax(vector: Column) -> Column:
    return let(doubles(vector), lambda v: map_with(v, _log_sum_exp(v), lambda x, z: x - z))


def softmax(vector: Column) -> Column:
    return let(doubles(vector), lambda v: map_with(v, _log_sum_exp(v), lambda x, z: F.exp(x - z)))


def one_hot(index: Column, size: int) -> Column:
    """Indicator vector; an index off the range gives all zeros."""
    inside = index.between(0, size - 1)
    vector = single_entry(F.when(inside, index).otherwise(0), F.when(inside, 1.0).otherwise(0.0), size)
    return vector.cast("array<float>")


def single_entry(position: Column, value: Column, size: int) -> Column:
    """Zeros but for ``value`` at ``position``, which must be in [0, size)."""
    at = position.cast("int")
    zero = F.lit(0.0)
    return F.concat(F.array_repeat(zero, at), F.array(value), F.array_repeat(zero, F.lit(size - 1) - at))


def add_scaled(x: Column, y: Column, scale: float | Column = 1.0) -> Column:
    """x + scale * y, element by element (residual add, bias add); different lengths are an error."""
    factor = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.zip_with(same_size(doubles(x), y), doubles(y), lambda a, b: a + factor * b)


# --- pixels -------------------------------------------------------------------------------------


def bytes_to_ints(data: Column) -> Column:
    """BINARY to ARRAY<INT> in 0..255, in the JVM; suits small images (see raster.decode_bytes)."""
    positions = F.sequence(F.lit(0), F.length(data) - 1)
    values = map_with(positions, F.hex(data), lambda i, h: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(data) > 0, values).otherwise(F.array().cast("array<int>"))


def ints_to_bytes(pixels: Column) -> Column:
    """ARRAY<INT> in 0..255 to BINARY; other values are an error."""

    def digits(p: Column) -> Column:
        fault = F.raise_error(F.concat(F.lit("not a byte: "), F.coalesce(p.cast("string"), F.lit("null"))))
        return F.when(p.between(0, 255), F.lpad(F.hex(p), 2, "0")).otherwise(fault.cast("string"))

    return F.unhex(F.array_join(F.transform(pixels, digits), ""))


def scale_pixels(pixels: Column) -> Column:
    """0..255 to [-1, 1]."""
    return F.transform(doubles(pixels), lambda v: v * (2.0 / 255) - 1.0)


def to_uint8(image: Column, rounding: str = "truncate", saturate: bool = False) -> Column:
    """[-1, 1] to 0..255. The default cuts off the fraction; 'nearest' undoes :func:`scale_pixels`.

    A value outside the range is an error, or goes to the nearest limit with ``saturate``.
    """
    if rounding not in ("truncate", "nearest"):
        raise ValueError(f"unknown rounding {rounding!r}")
    half = 0.5 if rounding == "nearest" else 0.0

    def pixel(v: Column) -> Column:
        level = F.floor((v + 1.0) * 127.5 + half)
        if saturate:
            return F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int")
        fault = F.raise_error(F.concat(F.lit("value off [-1, 1]: "), v.cast("string"))).cast("int")
        return F.when(level.isNull() | level.between(0, 255), level.cast("int")).otherwise(fault)

    return F.transform(doubles(image), pixel)


def to_unit_range(image: Column) -> Column:
    """[-1, 1] to [0, 1]."""
    return F.transform(doubles(image), lambda v: (v + 1.0) / 2.0)


def label_with_offset(label: Column, offset: int = 0, num_classes: int | None = None) -> Column:
    """Label as INT plus an offset; with ``num_classes`` a label off [0, num_classes) is an error."""
    shifted = label.cast("int") + F.lit(offset)
    if num_classes is None:
        return shifted
    fault = F.raise_error(F.concat(F.lit(f"label off [0, {num_classes}): "), shifted.cast("string")))
    return F.when(shifted.between(0, num_classes - 1), shifted).otherwise(fault.cast("int"))


def required(column: Column, what: str) -> Column:
    """The column itself; a null is an error."""
    return F.coalesce(column, F.raise_error(F.lit(f"{what} must not be null")))
