"""As-of joins: for each row the latest version that isn't after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import whole_div


def as_of(
    rows: DataFrame, at: str, versions: DataFrame, version: str, keys: Sequence[str] = (), how: str = "left", cells: int | None = None
) -> DataFrame:
    """Joins each row with the version of its keys whose whole number ``version`` is the largest not above the row's ``at``.

    Versions of a key are intervals that end where the next one begins. The range of version numbers is cut into
    cells, about as many as there are versions, and an interval is listed under each cell it touches, so rows find
    their version by an equality join on (keys, cell) and one comparison. Rows of one key are thus spread
    over cells, and no window sees rows. Rows before the first version, or with a null key or ``at``, have none: nulls
    with ``how='left'``, else they go with 'inner'. Two versions of a key with one number are an error.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown kind of join {how!r}")
    keys = list(keys)
    ends = versions.agg(F.min(version), F.max(version), F.count(F.lit(1))).first()
    first, last = ends[0] or 0, ends[1] or 0
    width = max(1, (last - first + 1) // max(1, cells or ends[2]))
    final = (last - first) // width

    following = F.lead(version).over(Window.partitionBy(*keys).orderBy(version))
    once = F.when(following == F.col(version), F.raise_error(F.concat(F.lit("two versions have the number "), F.col(version).cast("string"))).cast("bigint"))
    spans = versions.where(F.col(version).isNotNull()).withColumn("_until", F.coalesce(once, following))
    low = whole_div(F.col(version) - first, width)
    high = F.coalesce(F.least(whole_div(F.col("_until") - 1 - first, width), F.lit(final)), F.lit(final))
    spans = spans.withColumn("_cell", F.explode(F.sequence(low, high))).withColumnRenamed(version, "_from")
    kept = [F.col(c) for c in versions.columns if c not in (version, *keys)]
    spans = spans.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_cell", "_from", "_until", *kept)

    cell = F.least(whole_div(F.col(at) - first, width), F.lit(final))
    asked = rows.withColumn("_of", F.when(F.col(at) >= first, cell))
    match = (F.col("_of") == F.col("_cell")) & (F.col("_from") <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_key_{k}"))
    joined = asked.join(spans, match, how).withColumn(version, F.col("_from"))
    return joined.drop("_of", "_cell", "_from", "_until", *[f"_key_{k}" for k in keys])
