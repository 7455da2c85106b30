"""A membership filter over 64-bit keys, built and asked with SQL functions only.

The filter is a table of bitmaps with a fixed number of bits, so its size is known before it is built and it
may be broadcast at any size of the data. It never misses a key that was put in; as it fills up, it lets
more other keys through, and what asks it stays right, only slower.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap, fixed by bitmap_construct_agg.
PAGE = 32768


def build(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmaps (page, bitmap): at most bits / 32768 rows of 4 KB."""
    pages = max(1, bits // PAGE)
    return (
        keys.select(_page(F.col(key), pages).alias("page"), _slot(F.col(key)).alias("slot"))
        .where("slot is not null")
        .groupBy("page")
        .agg(F.bitmap_construct_agg("slot").alias("bitmap"))
    )


def ask(rows: DataFrame, key: str, pages: DataFrame, bits: int, answer: str) -> DataFrame:
    """Adds a boolean column: false means that the key was certainly not put in. Null keys get false."""
    count = max(1, bits // PAGE)
    small = F.broadcast(pages.select(F.col("page").alias("_page"), F.col("bitmap").alias("_bitmap")))
    joined = rows.join(small, _page(F.col(key), count) == F.col("_page"), "left")
    return joined.withColumn(answer, F.coalesce(bit(F.col("_bitmap"), _slot(F.col(key))), F.lit(False))).drop(
        "_page", "_bitmap"
    )


def bit(bitmap: Column, slot: Column) -> Column:
    """Whether a bit of a binary value is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(7).cast("int"))) != 0


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.shiftright(key, 15), F.lit(pages).cast("long"))


def _slot(key: Column) -> Column:
    return key.bitwiseAND(F.lit(PAGE - 1).cast("long"))
