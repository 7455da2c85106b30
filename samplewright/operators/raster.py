"""Image kernels on flat (y, x, channel) arrays, and contact sheets.

They run on Arrow batches: on 128 x 128 x 3 images pooling and upsampling took a third to a quarter of
the time of the same thing in array functions. An image stays in its row and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import doubles, to_uint8, whole_div
from ..functions.images import explode_pixels
from .kernels import FLOATS, INTS, arrow_kernel, image_kernel, matrix_to_vectors


def decode_bytes(data: Column, size: int) -> Column:
    """BINARY of exactly ``size`` bytes to ARRAY<INT> in 0..255, in Arrow batches."""

    @arrow_kernel(INTS)
    def decode(blobs: pa.Array) -> pa.Array:
        return matrix_to_vectors(_bytes_to_matrix(blobs, size), np.int32)

    return decode(data)


def decode_image(data: Column, size: int) -> Column:
    """BINARY of exactly ``size`` bytes to ARRAY<FLOAT> in [-1, 1].

    Same values as ``scale_pixels(decode_bytes(...))`` to single precision, without the whole numbers
    in between: a fraction of the time and half the memory.
    """

    @arrow_kernel(FLOATS)
    def decode(blobs: pa.Array) -> pa.Array:
        pixels = _bytes_to_matrix(blobs, size).astype(np.float32)
        pixels *= np.float32(2.0 / 255)
        pixels -= np.float32(1.0)
        return matrix_to_vectors(pixels, np.float32)

    return decode(data)


def _bytes_to_matrix(blobs: pa.Array, size: int) -> np.ndarray:
    lengths = pc.fill_null(pc.binary_length(blobs), -1).to_numpy(zero_copy_only=False)
    if np.any(lengths != size):
        raise ValueError(f"expected {size} bytes, found {sorted(set(lengths[lengths != size].tolist()))[:3]}")
    if not len(blobs):
        return np.empty((0, size), dtype=np.uint8)
    _, offsets, data = blobs.buffers()
    kind = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    start = int(np.frombuffer(offsets, dtype=kind)[blobs.offset])
    return np.frombuffer(data, dtype=np.uint8, count=len(blobs) * size, offset=start).reshape(len(blobs), size)


def avg_pool_2x2(image: Column, height: int, width: int, channels: int = 1) -> Column:
    """Mean of 2x2 blocks; an odd last row or column is left out."""
    return _pool_2x2(image, (height, width, channels), np.mean)


def max_pool_2x2(image: Column, height: int, width: int, channels: int = 1) -> Column:
    """Largest value of 2x2 blocks; an odd last row or column is left out."""
    return _pool_2x2(image, (height, width, channels), np.max)


def _pool_2x2(image: Column, shape: tuple[int, int, int], merge: Callable) -> Column:
    h, w, c = shape[0] // 2, shape[1] // 2, shape[2]

    @image_kernel
    def pool(x: np.ndarray) -> np.ndarray:
        return merge(x.reshape(-1, *shape)[:, :h * 2, :w * 2].reshape(-1, h, 2, w, 2, c), axis=(2, 4))

    return pool(doubles(image))


def upsample_nearest(image: Column, height: int, width: int, channels: int = 1, factor: int = 2) -> Column:
    """Repeats each pixel in a factor x factor block; factor 1 returns the input."""
    if factor == 1:
        return doubles(image)

    @image_kernel
    def upsample(x: np.ndarray) -> np.ndarray:
        return x.reshape(-1, height, width, channels).repeat(factor, axis=1).repeat(factor, axis=2)

    return upsample(doubles(image))


def spatial_sum(image: Column, channels: int, positive: bool = False) -> Column:
    """Sum over all positions per channel; ``positive`` counts values above zero only."""

    @image_kernel
    def add_up(x: np.ndarray) -> np.ndarray:
        x = x.reshape(len(x), -1, channels)
        return (np.maximum(x, 0.0) if positive else x).sum(axis=1)

    return add_up(doubles(image))


def resize_bilinear(image: Column, height: int, width: int, channels: int, out_height: int, out_width: int) -> Column:
    """Bilinear resize; source position = target position * in / out, neighbours clamped to the edge."""
    rows, cols = _axis(height, out_height), _axis(width, out_width)

    @image_kernel
    def resize(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, height, width, channels)
        lo, hi, part = rows
        x = x[:, lo] * (1 - part)[None, :, None, None] + x[:, hi] * part[None, :, None, None]
        lo, hi, part = cols
        return x[:, :, lo] * (1 - part)[None, None, :, None] + x[:, :, hi] * part[None, None, :, None]

    return resize(doubles(image))


def _axis(size: int, out_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(out_size) * (size / out_size)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, size - 1), at - low


def focal_sum(
    image: Column,
    height: int,
    width: int,
    kernel: np.ndarray,
    stride: int = 1,
    bias: Sequence[float] | None = None,
) -> Column:
    """Weighted sum of each pixel's neighbourhood with a given kernel (k_h, k_w, c_in, c_out).

    Output size is ceil(in / stride); the border is zero-padded, the odd cell at the bottom or right.
    """
    k_h, k_w, c_in, c_out = kernel.shape
    out_h, top = _padding(height, k_h, stride)
    out_w, left = _padding(width, k_w, stride)
    shift = np.zeros(c_out) if bias is None else np.asarray(bias, dtype=np.float64)

    @image_kernel
    def convolve(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, height, width, c_in)
        padded = np.zeros((len(x), (out_h - 1) * stride + k_h + stride, (out_w - 1) * stride + k_w + stride, c_in))
        padded[:, top:top + height, left:left + width] = x[:, :padded.shape[1] - top, :padded.shape[2] - left]
        out = np.tile(shift, (len(x), out_h, out_w, 1))
        for dy in range(k_h):
            for dx in range(k_w):
                seen = padded[:, dy:dy + out_h * stride:stride, dx:dx + out_w * stride:stride]
                out += seen @ kernel[dy, dx]
        return out

    return convolve(doubles(image))


def _padding(size: int, k: int, stride: int) -> tuple[int, int]:
    out = -(-size // stride)
    return out, max((out - 1) * stride + k - size, 0) // 2


def montage_pixels(
    tiles: DataFrame,
    image: str,
    tile: str,
    height: int,
    width: int,
    channels: int,
    rows: int,
    cols: int,
    order: str = "row",
) -> DataFrame:
    """Contact sheets as pixel rows: tile number ``tile`` (0-based within its sheet) gives the place.

    ``order='column'`` fills columns first. Columns of the result: the others of ``tiles``, then ``y``
    and ``x`` on the sheet, ``c`` and ``v``.
    """
    row, col = _place(F.col(tile), rows, cols, order)
    placed = tiles.withColumn("_row", row).withColumn("_col", col)
    pixels = explode_pixels(placed, image, width, channels)
    return pixels.withColumns({
        "y": (F.col("_row") * height + F.col("y")).cast("int"),
        "x": (F.col("_col") * width + F.col("x")).cast("int"),
    }).drop("_row", "_col", tile)


def montage_sheets(
    tiles: DataFrame,
    image: str,
    tile: str,
    sheet: Sequence[str],
    height: int,
    width: int,
    channels: int,
    rows: int,
    cols: int,
    order: str = "row",
) -> DataFrame:
    """Contact sheets as raw bytes: (sheet columns, height, width, canvas) from images in [-1, 1].

    A sheet holds rows * cols images, which bounds a group; places without an image are 0.
    """
    sheet = list(sheet)
    row, col = _place(F.col(tile), rows, cols, order)
    placed = tiles.select(*sheet, row.alias("_row"), col.alias("_col"), to_uint8(F.col(image)).alias("_pixels"))
    schema = T.StructType([
        *[tiles.schema[s] for s in sheet],
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
        T.StructField("canvas", T.BinaryType()),
    ])

    def assemble(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        canvas = np.zeros((rows * height, cols * width, channels), dtype=np.uint8)
        for r, c, pixels in zip(group["_row"], group["_col"], group["_pixels"]):
            block = np.asarray(pixels, dtype=np.uint8).reshape(height, width, channels)
            canvas[r * height:(r + 1) * height, c * width:(c + 1) * width] = block
        return pd.DataFrame([[*key, canvas.shape[0], canvas.shape[1], canvas.tobytes()]], columns=schema.names)

    return placed.groupBy(*sheet).applyInPandas(assemble, schema)


def _place(tile: Column, rows: int, cols: int, order: str) -> tuple[Column, Column]:
    if order == "row":
        return whole_div(tile, cols), tile % cols
    if order == "column":
        return tile % rows, whole_div(tile, rows)
    raise ValueError(f"unknown order {order!r}")
