"""Layout of flat (y, x, channel) image arrays, and grid sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, whole_div


def _div(a: Column, n: int) -> Column:
    return whole_div(a, n).cast("int")


def explode_pixels(df: DataFrame, image: str, width: int, channels: int = 1) -> DataFrame:
    """One row per pixel value: columns y, x, c, v instead of the image."""
    keep = [c for c in df.columns if c != image]
    tall = df.select(*keep, F.posexplode(image).alias("_j", "_v"))
    return tall.select(
        *keep,
        _div(F.col("_j"), width * channels).alias("y"),
        (_div(F.col("_j"), channels) % width).alias("x"),
        (F.col("_j") % channels).alias("c"),
        F.col("_v").cast("double").alias("v"),
    )


def collect_pixels(df: DataFrame, keys: list[str], width: int, channels: int, image: str = "image") -> DataFrame:
    """Back from pixel rows to one flat array per key (one image per group, so groups are small)."""
    at = (F.col("y") * width + F.col("x")) * channels + F.col("c")
    cells = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at.alias("j"), F.col("v")))).alias("_cells"))
    return cells.select(*keys, F.transform("_cells", lambda cell: cell["v"]).alias(image))


def squarest_grid(n: Column) -> Column:
    """(height, width) of the most square grid of n tiles: width = largest divisor up to the root."""
    roots = F.sequence(F.lit(1).cast("bigint"), F.floor(F.sqrt(n.cast("double"))).cast("bigint"))
    width = F.array_max(F.filter(roots, lambda d: n.cast("bigint") % d == 0))
    return let(width, lambda w: F.struct(whole_div(n.cast("bigint"), w).alias("height"), w.alias("width")))
