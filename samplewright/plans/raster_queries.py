"""Queries on images: every embedding as an 8 x 8 x 1 (or 4 x 4 x 4) image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images as I
from ..operators import feed, raster
from ..operators.ranking import ordered_rank
from . import jobs
from .feed_queries import _shuffled_sql
from .registry import EMB, query, rounded, table

IMAGE = "image AS (SELECT vec_id, label, j // 8 AS y, j % 8 AS x, v FROM emb)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "image")


def _pixels(df: DataFrame, image: Column, width: int, channels: int = 1) -> DataFrame:
    made = I.explode_pixels(df.select("vec_id", image.alias("image")), "image", width, channels)
    made = made.withColumn("v", rounded("v"))
    return made if channels > 1 else made.drop("c")


@query(f"""WITH {EMB} SELECT vec_id, (j // 16)::INTEGER AS y, (j // 4 % 4)::INTEGER AS x, (j % 4)::INTEGER AS c,
  round(v, 6) + 0.0 AS v FROM emb""")
def raster_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), F.col("image"), 4, 4)


@query(f"""WITH {EMB} SELECT vec_id, (j % 4)::INTEGER AS channel, round(sum(v), 6) + 0.0 AS total FROM emb GROUP BY ALL""")
def spatial_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _images(spark, sf_dir).select("vec_id", F.posexplode(raster.spatial_sum(F.col("image"), 4)).alias("channel", "total"))
    return sums.withColumn("total", rounded("total"))


def _pool_sql(merge: str) -> str:
    return f"""WITH {EMB}, {IMAGE}
SELECT vec_id, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, round({merge}(v), 6) + 0.0 AS v
FROM image GROUP BY vec_id, y // 2, x // 2"""


@query(_pool_sql("avg"))
def avg_pool_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), raster.avg_pool_2x2(F.col("image"), 8, 8), 4)


@query(_pool_sql("max"))
def max_pool_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), raster.max_pool_2x2(F.col("image"), 8, 8), 4)


@query(f"""WITH {EMB}, {IMAGE}, o AS (SELECT unnest(range(2)) AS o)
SELECT vec_id, (y * 2 + a.o)::INTEGER AS y, (x * 2 + b.o)::INTEGER AS x, round(v, 6) + 0.0 AS v FROM image, o a, o b""")
def upsample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), raster.upsample_nearest(F.col("image"), 8, 8), 16)


@query(f"""WITH {EMB}, {IMAGE},
axis AS (
  SELECT d, floor(d * 8 / 12.0)::INTEGER AS lo, least(floor(d * 8 / 12.0)::INTEGER + 1, 7) AS hi,
    d * 8 / 12.0::DOUBLE - floor(d * 8 / 12.0::DOUBLE) AS part
  FROM (SELECT unnest(range(12)) AS d)),
taps AS (SELECT d, lo AS at, 1 - part AS w FROM axis UNION ALL SELECT d, hi, part FROM axis)
SELECT vec_id, r.d::INTEGER AS y, c.d::INTEGER AS x, round(sum(v * r.w * c.w), 6) + 0.0 AS v
FROM image JOIN taps r ON r.at = y JOIN taps c ON c.at = x GROUP BY vec_id, r.d, c.d""")
def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), raster.resize_bilinear(F.col("image"), 8, 8, 1, 12, 12), 12)


# 3 x 3 kernel from one channel to two, and their biases.
KERNEL = np.array([[[[((dy * 3 + dx + o * 2) % 5 - 2) / 4.0 for o in range(2)]] for dx in range(3)] for dy in range(3)])
KERNEL_BIAS = [0.25, -0.5]


def _focal_sql(stride: int, out: int, pad: int) -> str:
    return f"""WITH {EMB}, {IMAGE},
kernel AS (
  SELECT dy, dx, o, ((dy * 3 + dx + o * 2) % 5 - 2) / 4.0 AS w
  FROM (SELECT unnest(range(3)) AS dy), (SELECT unnest(range(3)) AS dx), (SELECT unnest(range(2)) AS o)),
cells AS (SELECT a.c AS oy, b.c AS ox FROM (SELECT unnest(range({out})) AS c) a, (SELECT unnest(range({out})) AS c) b)
SELECT vec_id, oy::INTEGER AS y, ox::INTEGER AS x, o::INTEGER AS c,
  round(sum(v * w) + CASE o WHEN 0 THEN 0.25 ELSE -0.5 END, 6) + 0.0 AS v
FROM cells, kernel JOIN image ON image.y = oy * {stride} + dy - {pad} AND image.x = ox * {stride} + dx - {pad}
GROUP BY vec_id, oy, ox, o"""


@query(_focal_sql(1, 8, 1))
def focal_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), raster.focal_sum(F.col("image"), 8, 8, KERNEL, 1, KERNEL_BIAS), 8, 2)


@query(_focal_sql(2, 4, 0))
def focal_sum_stride_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(_images(spark, sf_dir), raster.focal_sum(F.col("image"), 8, 8, KERNEL, 2, KERNEL_BIAS), 4, 2)


@query(f"""WITH {EMB}, {IMAGE},
ranked AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)
SELECT label, r // 16 AS sheet, (r % 16 // 4 * 8 + y)::INTEGER AS y, (r % 16 % 4 * 8 + x)::INTEGER AS x, round(v, 6) + 0.0 AS v
FROM image JOIN ranked USING (vec_id)""")
def montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images of a label on 4 x 4 sheets, in id order."""
    pixels = raster.montage_pixels(_tiles(spark, sf_dir), "image", "tile", 8, 8, 1, 4, 4)
    return pixels.select("label", "sheet", "y", "x", rounded("v").alias("v"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ordered_rank(_images(spark, sf_dir), "vec_id", group=["label"])
    return ranked.select(
        "label", F.call_function("div", F.col("rank"), F.lit(16)).alias("sheet"), (F.col("rank") % 16).alias("tile"), "image"
    )


@query(f"""WITH {EMB}, {IMAGE},
ranked AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings)
SELECT label, r // 16 AS sheet, 32::INTEGER AS height, 32::INTEGER AS width,
  sum(floor((v + 1) * 127.5)::BIGINT * ((r % 16 % 4 * 8 + y) * 32 + r % 16 // 4 * 8 + x + 1))::BIGINT AS checksum
FROM image JOIN ranked USING (vec_id) GROUP BY label, r // 16""")
def montage_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheets filled by columns, as bytes; compared by a position-weighted sum."""
    sheets = raster.montage_sheets(_tiles(spark, sf_dir), "image", "tile", ["label", "sheet"], 8, 8, 1, 4, 4, order="column")
    return _checksums(sheets, ["label", "sheet"], 32 * 32)


def _checksums(sheets: DataFrame, keys: list[str], size: int) -> DataFrame:
    pixels = raster.decode_bytes(F.col("canvas"), size)
    tall = sheets.select(*keys, "height", "width", F.posexplode(pixels).alias("at", "pixel"))
    return tall.groupBy(*keys, "height", "width").agg(
        F.sum(F.col("pixel").cast("bigint") * (F.col("at") + 1)).alias("checksum")
    )


@query(f"""WITH {EMB}, {IMAGE}, {_shuffled_sql("embeddings", "vec_id", 17, 1)}
SELECT rank // 50 AS batch_id, 32::INTEGER AS height, 24::INTEGER AS width,
  sum(floor((v + 1) * 127.5)::BIGINT * ((rank % 50 // 3 * 8 + y) * 24 + rank % 50 % 3 * 8 + x + 1))::BIGINT AS checksum
FROM image JOIN shuffled USING (vec_id) WHERE rank % 50 < 12 GROUP BY rank // 50""")
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 3 sheet of the first 12 images of every shuffled batch of 50."""
    batched = feed.assign_batches(feed.shuffle_records(_images(spark, sf_dir), "vec_id", seed=17), 50)
    return _checksums(jobs.contact_sheets(batched, "image", 8, 8, 1, show=12), ["batch_id"], 32 * 24)


@query("""WITH n AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size),
d AS (SELECT p_size, n, unnest(range(1, sqrt(n)::BIGINT + 2)) AS d FROM n)
SELECT p_size, n, n // max(d) AS height, max(d) AS width FROM d WHERE d * d <= n AND n % d = 0 GROUP BY p_size, n""")
def squarest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid for the parts of each size."""
    groups = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n"))
    return groups.select("p_size", "n", I.squarest_grid(F.col("n")).alias("g")).select("p_size", "n", "g.height", "g.width")
