"""Queries on record preparation: decode, labels, interleave, shuffle, repeat, batch, sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import ints_to_bytes, label_with_offset, scale_pixels, to_uint8
from ..operators import feed, generate, weave
from ..operators.runs import RunTable
from ..session import scratch_path, store
from ..sources import register
from . import jobs
from .registry import EMB, query, rounded, sql_hash, table

BATCH = 64
TOWERS = 4


@query(f"""WITH {EMB}
SELECT vec_id, j::INTEGER AS pos, floor((v + 1.0) * 127.5)::INTEGER AS pixel,
  round(floor((v + 1.0) * 127.5) * (2.0::DOUBLE / 255) - 1.0, 6) + 0.0 AS scaled
FROM emb""")
def scale_pixels_to_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", to_uint8(F.col("embedding")).alias("pixels"))
    pairs = F.arrays_zip(F.col("pixels").alias("pixel"), scale_pixels(F.col("pixels")).alias("scaled"))
    tall = pixels.select("vec_id", F.posexplode(pairs).alias("pos", "p"))
    return tall.select("vec_id", "pos", F.col("p.pixel").alias("pixel"), rounded("p.scaled").alias("scaled"))


@query(f"""WITH {EMB}
SELECT vec_id, (label - 1)::INTEGER AS label, j::INTEGER AS pos,
  round((floor((v + 1.0) * 127.5)::FLOAT * (2.0::DOUBLE / 255)::FLOAT - 1::FLOAT)::DOUBLE, 6) + 0.0 AS scaled
FROM emb""")
def tfrecord_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding written as an image record, and read back through the file format (single precision)."""
    register(spark)
    path = scratch_path(spark, "records")
    records = table(spark, sf_dir, "embeddings").select(
        ints_to_bytes(to_uint8(F.col("embedding"))).alias("image_raw"), F.col("label").cast("bigint").alias("label"), "vec_id"
    )
    records.write.format("tfrecord").mode("append").save(path)
    images = jobs.read_images(spark, path, image_bytes=64, label_offset=-1, extra="vec_id BIGINT NOT NULL")
    tall = images.select("vec_id", "label", F.posexplode("image").alias("pos", "v"))
    return tall.select("vec_id", "label", "pos", rounded(F.col("v").cast("double")).alias("scaled"))


@query("""WITH e AS (SELECT label, floor((embedding[1]::DOUBLE + 1.0) * 127.5)::INTEGER AS first FROM embeddings),
epochs AS (SELECT unnest(range(2))::INTEGER AS epoch),
n AS (SELECT count(*) AS n FROM e)
SELECT epoch, label::INTEGER AS label, count(*) AS records, sum(first)::BIGINT AS first_pixels,
  (SELECT n FROM n) AS ranks, (SELECT (n * 2 + 31) // 32 FROM n) AS batches
FROM e, epochs GROUP BY epoch, label""")
def records_to_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files of images and labels alone, read back, interleaved, shuffled over two epochs and batched.

    File names are drawn at random, so the order can't be stated in SQL: per epoch and label, how many
    records came through and the sum of their first pixels; over all, the ranks and batches given.
    """
    register(spark)
    path = scratch_path(spark, "records")
    records = table(spark, sf_dir, "embeddings").select(
        ints_to_bytes(to_uint8(F.col("embedding"))).alias("image_raw"), F.col("label").cast("bigint").alias("label")
    )
    records.repartition(5).write.format("tfrecord").mode("append").save(path)
    images = jobs.read_images(spark, path, image_bytes=64)
    woven = feed.interleave_shards(images, "_shard", "_offset", cycle_length=2, seed=5)
    shuffled = feed.shuffle_records(woven.drop("cycle", "slot", "pos"), "record", seed=5, epochs=2, total="total")
    batched = feed.assign_batches(shuffled, 32, False, total="total")
    first = F.round((F.get("image", F.lit(0)).cast("double") + 1.0) * 127.5).cast("bigint")
    batched = store(batched.select("epoch", "label", "record", "seq", "batch_id", first.alias("first")), "batched")
    by_label = batched.groupBy("epoch", "label").agg(
        F.count_distinct("record").alias("records"), F.sum("first").alias("first_pixels")
    )
    whole = batched.agg(F.count_distinct("seq").alias("ranks"), F.count_distinct("batch_id").alias("batches"))
    return by_label.withColumns({c: whole.select(c).scalar() for c in ("ranks", "batches")})


@query("""SELECT doc_id, source, (quality - 1)::INTEGER AS label
FROM documents JOIN labels USING (doc_id)""")
def label_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select("doc_id", "source", label_with_offset(F.col("quality"), -1).alias("label"))


@query(f"""WITH shards AS (
  SELECT source, row_number() OVER (ORDER BY {sql_hash("'3:shards:' || source", 15)}, source) - 1 AS shard_rank
  FROM (SELECT DISTINCT source FROM documents)),
placed AS (
  SELECT doc_id, source, shard_rank // 4 AS cycle, (shard_rank % 4)::INTEGER AS slot,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents JOIN shards USING (source))
SELECT doc_id, source, cycle, slot, pos, row_number() OVER (ORDER BY cycle, pos, slot) - 1 AS seq FROM placed""")
def interleave_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "documents").select("doc_id", "source")
    return feed.interleave_shards(records, "source", "doc_id", cycle_length=4, seed=3)


@query(f"""WITH RECURSIVE shards AS (
  SELECT shard, n, row_number() OVER (ORDER BY {sql_hash("'3:shards:' || shard", 15)}, shard) AS k
  FROM (SELECT lang || '/' || source AS shard, count(*) AS n FROM documents GROUP BY ALL)),
-- Each shard goes to the slot that is free first; free holds the turn from which each slot is.
filled AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS slot, 0::BIGINT AS start, [0, 0, 0, 0, 0]::BIGINT[] AS free
  UNION ALL
  SELECT s.k, list_position(f.free, list_min(f.free)) - 1, list_min(f.free),
    f.free[:list_position(f.free, list_min(f.free)) - 1] || [list_min(f.free) + s.n + 1]
      || f.free[list_position(f.free, list_min(f.free)) + 1:]
  FROM filled f JOIN shards s ON s.k = f.k + 1),
records AS (
  SELECT doc_id, lang || '/' || source AS shard, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT doc_id, shard, slot::INTEGER AS slot, pos, start + pos AS turn, row_number() OVER (ORDER BY start + pos, slot) - 1 AS seq
FROM records JOIN shards USING (shard) JOIN filled USING (k)""")
def interleave_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of very different lengths over five slots, which are filled again when a shard ends."""
    shard = F.concat("lang", F.lit("/"), "source").alias("shard")
    return weave.interleave_refill(table(spark, sf_dir, "documents").select("doc_id", shard), "shard", "doc_id", cycle_length=5, seed=3)


@query(f"""WITH placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
keyed AS (
  SELECT o_orderkey, place, n, epoch::INTEGER AS epoch,
    place + (({sql_hash("'5:buffer:' || epoch || ':' || place", 8)} * 500) >> 32) AS key
  FROM placed, (SELECT unnest(range(2)) AS epoch))
SELECT o_orderkey, epoch, place, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY key, place) - 1 AS rank FROM keyed""")
def shuffle_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs through a buffer of 500 records."""
    return weave.shuffle_buffered(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", buffer=500, seed=5, epochs=2)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")


def _shuffled_sql(source: str, record: str, seed: int, epochs: int, extra: str = "") -> str:
    """Rows of every epoch with shuffle_key and rank."""
    key = sql_hash(f"'{seed}:shuffle:' || epoch || ':' || {record}", 15)
    return f"""keyed AS (
  SELECT {record}{extra}, epoch::INTEGER AS epoch, {key} AS shuffle_key
  FROM {source}, (SELECT unnest(range({epochs})) AS epoch)),
shuffled AS (
  SELECT *, row_number() OVER (ORDER BY epoch, shuffle_key, {record}) - 1 AS rank, count(*) OVER () AS total FROM keyed)"""


@query(f"""WITH {_shuffled_sql("orders", "o_orderkey", 7, 1)}
SELECT o_orderkey, epoch, shuffle_key, rank FROM shuffled""")
def shuffle_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.shuffle_records(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", seed=7)


@query(f"""WITH {_shuffled_sql("labels", "doc_id", 8, 3)}
SELECT doc_id, epoch, rank FROM shuffled""")
def repeat_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = feed.shuffle_records(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", seed=8, epochs=3)
    return shuffled.select("doc_id", "epoch", "rank")


@query(f"""WITH {_shuffled_sql("orders", "o_orderkey", 9, 2)}
SELECT o_orderkey, epoch, rank // {BATCH} AS batch_id, (rank % {BATCH})::INTEGER AS position
FROM shuffled WHERE rank < total // {BATCH} * {BATCH}""")
def batches_dropping_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = feed.shuffle_records(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", seed=9, epochs=2, total="total")
    batched = feed.assign_batches(ranked, BATCH, drop_remainder=True, total="total")
    return batched.select("o_orderkey", "epoch", "batch_id", "position")


@query(f"""WITH {_shuffled_sql("orders", "o_orderkey", 7, 1)}
SELECT o_orderkey, rank // {BATCH} AS batch_id, rank // {BATCH} // {TOWERS} AS step_id,
  (rank // {BATCH} % {TOWERS})::INTEGER AS tower_id, (rank % {BATCH})::INTEGER AS position
FROM shuffled""")
def tower_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = feed.assign_batches(shuffle_epoch(spark, sf_dir), BATCH)
    return feed.split_towers(batched, TOWERS).select("o_orderkey", "batch_id", "step_id", "tower_id", "position")


@query(f"""WITH {_shuffled_sql("orders", "o_orderkey", 7, 1)}
SELECT o_orderkey, rank // 100 AS batch_id, (rank % 100)::INTEGER AS position
FROM shuffled WHERE rank < total // 100 * 100""")
def take_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many whole batches of 100 as the table holds, asked for by number."""
    available = _orders(spark, sf_dir).count()
    taken = feed.take_batches(shuffle_epoch(spark, sf_dir), 100, available // 100, available)
    return taken.select("o_orderkey", "batch_id", "position")


@query(f"""WITH {_shuffled_sql("orders", "o_orderkey", 7, 1, ", o_totalprice")},
placed AS (
  SELECT o_orderkey, rank // {BATCH} AS batch_id,
    row_number() OVER (PARTITION BY rank // {BATCH} ORDER BY o_totalprice, o_orderkey) - 1 AS place
  FROM shuffled),
counted AS (SELECT *, batch_id * {BATCH} + place AS counter FROM placed)
SELECT o_orderkey, batch_id, place::INTEGER AS place, counter,
  CASE WHEN counter < 1000 THEN chr((97 + counter % 10)::INTEGER) || counter || '.png'
       ELSE 'fake' || (counter - 1000) || '.png' END AS name
FROM counted""")
def rank_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = feed.shuffle_records(_orders(spark, sf_dir), "o_orderkey", seed=7)
    exported = feed.rank_by_score(feed.assign_batches(ranked, BATCH), "o_totalprice", "o_orderkey", BATCH)
    return exported.select("o_orderkey", "batch_id", "place", "counter", "name")


@query(f"""WITH {_shuffled_sql("orders", "o_orderkey", 7, 1)}
SELECT o_orderkey, rank // {BATCH} AS batch_id, (rank % {BATCH})::INTEGER AS position
FROM shuffled WHERE rank % {BATCH} < 16""")
def head_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = feed.head_per_batch(feed.assign_batches(shuffle_epoch(spark, sf_dir), BATCH), 16)
    return heads.select("o_orderkey", "batch_id", "position")


@query("""SELECT vec_id, label, (vec_id % 2)::INTEGER AS run FROM embeddings""")
def accumulate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended; the runs name their columns in different order."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).cast("int").alias("run"))
    return feed.accumulate([vectors.filter("run = 0"), vectors.filter("run = 1").select("run", "label", "vec_id")])


@query("""SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS run FROM embeddings""")
def accumulate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs that append to one table, the first one twice: its second attempt replaces what the first one left."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    runs = RunTable(spark, scratch_path(spark, "runs"))
    even = F.col("vec_id") % 2 == 0
    runs.append("even", vectors.filter(even).withColumn("label", F.lit(-1)))
    runs.append("odd", vectors.filter(~even).select("label", "vec_id"))
    runs.append("even", vectors.filter(even))
    return runs.read()


@query("""SELECT CASE WHEN vec_id % 7 = 3 THEN 'image_raw has 63 bytes, not 64'
    WHEN vec_id % 7 = 5 THEN 'missing feature ' || chr(39) || 'label' || chr(39) END AS reason,
  count(*) AS records, sum(CASE WHEN vec_id % 7 IN (3, 5) THEN NULL ELSE label END)::BIGINT AS labels, count(*) AS places
FROM embeddings GROUP BY reason""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record files with planted damage, sorted in one scan: how many records came through, and how many did not for which reason."""
    register(spark)
    source = scratch_path(spark, "damaged")
    pixels = ints_to_bytes(to_uint8(F.col("embedding")))
    images = table(spark, sf_dir, "embeddings").select(
        F.when(F.col("vec_id") % 7 == 3, F.substring(pixels, 1, 63)).otherwise(pixels).alias("image_raw"),
        F.col("label").cast("bigint").alias("label"),
        "vec_id",
    )
    images.filter("vec_id % 7 <> 5").write.format("tfrecord").mode("append").save(source)
    images.filter("vec_id % 7 = 5").drop("label").write.format("tfrecord").mode("append").save(source)
    made = jobs.Sorted(spark, scratch_path(spark, "sorted"))
    made.write(source, image_bytes=64)
    good = made.good().agg(
        F.lit(None).cast("string").alias("reason"), F.count("*").alias("records"), F.sum("label").alias("labels"),
        F.count_distinct("_shard", "_offset").alias("places"),
    )
    bad = made.bad().groupBy("reason").agg(
        F.count("*").alias("records"), F.lit(None).cast("bigint").alias("labels"), F.count_distinct("shard", "offset").alias("places")
    )
    return good.unionByName(bad)


# --- sample tables -------------------------------------------------------------------------------


def _normal_sql(source: str, row: str, size: int, seed: int) -> str:
    """normal(row, pos, z): two 60-bit keys per digest, a Box-Muller pair from the two halves of a key."""
    return f"""digests AS (
  SELECT {row} AS row, b, md5('{seed}:noise:' || {row} || ':' || b) AS d
  FROM {source}, (SELECT unnest(range({(size + 3) // 4})) AS b)),
keys AS (
  SELECT row, b, k, ('0x' || substr(d, 1 + (k // 2 * 16)::INTEGER, 15))::BIGINT AS key
  FROM digests, (SELECT unnest(range(4)) AS k)),
words AS (
  SELECT row, b, k, ((key >> 30) + 1) / 1073741824.0::DOUBLE AS u, (key & 1073741823) / 1073741824.0::DOUBLE AS turn
  FROM keys),
normal AS (
  SELECT row, (b * 4 + k)::INTEGER AS pos, sqrt(-2.0 * ln(u)) *
    CASE WHEN k % 2 = 0 THEN cos(2 * pi() * turn) ELSE sin(2 * pi() * turn) END AS z
  FROM words WHERE b * 4 + k < {size})"""


@query(f"""WITH {_normal_sql("embeddings", "vec_id", 128, 11)}
SELECT row AS vec_id, pos, round(z, 6) + 0.0 AS z FROM normal""")
def normal_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = generate.with_noise(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 128, seed=11)
    return noise.select("vec_id", F.posexplode("z").alias("pos", "z")).withColumn("z", rounded("z"))


@query(f"""SELECT o_orderkey, (({sql_hash("'12:class:' || o_orderkey", 8)} * 1000) >> 32)::INTEGER AS class_id FROM orders""")
def uniform_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.with_uniform_class(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", 1000, seed=12)


@query(f"""WITH weights AS (SELECT label AS class_id, count(*) AS weight FROM embeddings GROUP BY label),
bounds AS (
  SELECT class_id, (sum(weight) OVER (ORDER BY class_id))::DOUBLE / (sum(weight) OVER ())::DOUBLE AS hi FROM weights),
ranges AS (SELECT class_id, coalesce(lag(hi) OVER (ORDER BY class_id), 0.0) AS lo, hi FROM bounds),
draws AS (SELECT o_orderkey, {sql_hash("'13:class:' || o_orderkey", 8)} / 4294967296.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, class_id FROM draws JOIN ranges ON lo <= u AND u < hi""")
def weighted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("class_id")).agg(F.count("*").alias("weight"))
    return generate.with_weighted_class(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey", weights, seed=13)


@query("""WITH steps AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS step, count(*) OVER () AS n FROM embeddings),
swept AS (SELECT vec_id, step, n, unnest(range(100))::INTEGER AS dim FROM steps)
SELECT vec_id, dim, step, round(step::DOUBLE / n, 6) + 0.0 AS value, round(step::DOUBLE / n, 6) + 0.0 AS at_dim,
  127 + (step = 0)::INTEGER AS zeros FROM swept""")
def latent_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = generate.latent_traversal(table(spark, sf_dir, "embeddings"), "vec_id", z_dim=128, dims=100)
    return swept.select(
        "vec_id", "dim", "step",
        rounded("value").alias("value"),
        rounded(F.get("z", F.col("dim"))).alias("at_dim"),
        F.size(F.filter("z", lambda x: x == 0)).alias("zeros"),
    )


@query(f"""WITH {_shuffled_sql("embeddings", "vec_id", 21, 3, ", label")},
kept AS (SELECT * FROM shuffled WHERE rank < total // 32 * 32),
{_normal_sql("kept", "rank", 4, 21)}
SELECT vec_id, label, epoch, rank // 32 // 4 AS step_id, (rank // 32 % 4)::INTEGER AS tower_id,
  (rank % 32)::INTEGER AS position, (({sql_hash("'21:class:' || rank", 8)} * 10) >> 32)::INTEGER AS fake_label,
  pos, round(z, 6) + 0.0 AS z
FROM kept JOIN normal ON kept.rank = normal.row""")
def training_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    made = jobs.training_feed(records, "vec_id", epochs=3, batch_size=32, num_towers=4, z_dim=4, num_classes=10, seed=21)
    return made.select(
        "vec_id", "label", "epoch", "step_id", "tower_id", "position", "fake_label", F.posexplode("z").alias("pos", "z")
    ).withColumn("z", rounded("z"))
