"""Row numbers over whole tables without putting a table, or a hot group, into one task.

Rows are cut into buckets that follow the wanted order. Counting the buckets is a map-side
aggregation over the ordering columns only; a running sum of the counts gives each bucket its offset,
and a window inside (group, bucket) gives the rest. Rows travel once, hashed by (group, bucket): the
join to the offsets uses the same hashing, and the order the window left behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import required
from ..functions.hashing import KEY_BITS

# Wanted size of a bucket, and the limits of their number: 2**20 buckets of 100 MB make 100 TB, and
# their offsets a table of some 16 MB.
BUCKET_BYTES = 16 << 20
FEWEST_BITS, MOST_BITS = 8, 20
MOST_CUTS = 1 << 14
# Sources that don't know their size are estimated at about 2**63 bytes.
UNKNOWN_BYTES, UNKNOWN_BITS = 1 << 57, 12


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_bits(df: DataFrame) -> int:
    """Bits of a hash that make buckets of a comfortable size. Only speed depends on the estimate."""
    size = estimated_bytes(df)
    if size > UNKNOWN_BYTES:
        return UNKNOWN_BITS
    wanted = size // BUCKET_BYTES
    return min(max(wanted.bit_length(), FEWEST_BITS), MOST_BITS)


def hash_bucket(key: Column, bits: int) -> Column:
    """Leading bits of a 60-bit hash key; buckets follow the order of the key."""
    return F.shiftright(key, KEY_BITS - bits)


def bucketed_rank(
    df: DataFrame,
    bucket: str,
    order: Sequence[str],
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Adds the 0-based position of each row within its group.

    ``bucket`` must not decrease along ``order``, and ``order`` must be unique within the group.
    ``total`` names a column for the group's row count. ``per_group`` (one row per group) is joined to
    the offsets, not to the rows, so a hot group costs nothing extra.
    """
    group = list(group)
    for name in group:
        df = df.withColumn(name, required(F.col(name), name))
    # Rows without an ordering value stay, in a bucket before all others. Saying that the bucket is never
    # null also spares the null check, which would compute it a second time.
    df = df.withColumn(bucket, F.coalesce(F.col(bucket), F.lit(-1)))
    keys = [*group, bucket]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    over = Window.partitionBy(*group)
    before = over.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(*keys, (F.sum("_count").over(before) - F.col("_count")).alias("_bucket_offset"),
                           *([F.sum("_count").over(over).alias(total)] if total else []))
    if per_group is not None:
        offsets = offsets.join(per_group, group)
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside) - 1)
    ranked = numbered.join(offsets, keys)
    return ranked.withColumn(rank, (F.col("_bucket_offset") + F.col("_inside")).cast("bigint")).drop("_bucket_offset", "_inside", bucket)


def ordered_rank(
    df: DataFrame,
    order: str,
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str | None = None,
    buckets: int | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Position in the order of a numeric column that is unique within its group.

    Bucket limits are approximate quantiles of the column, found in one pass over that column. They
    only steer how evenly the work is cut; the ranks are exact.
    """
    if buckets is None:
        buckets = min(2 << bucket_bits(df), MOST_CUTS)
    as_double = df.select(F.col(order).cast("double").alias("_at"))
    cuts = as_double.approxQuantile("_at", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    tagged = df.withColumn("_at", F.col(order).cast("double"))
    if len(splits) > 2:
        bucketizer = Bucketizer(splits=splits, inputCol="_at", outputCol="_bucket", handleInvalid="keep")
        tagged = bucketizer.transform(tagged).withColumn("_bucket", F.col("_bucket").cast("int"))
    else:
        tagged = tagged.withColumn("_bucket", F.lit(0))
    tagged = tagged.drop("_at")
    return bucketed_rank(tagged, "_bucket", [order], group=group, rank=rank, total=total, per_group=per_group)
