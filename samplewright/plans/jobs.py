"""The two end-to-end jobs: preparing a training feed and evaluating generated samples."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..commits import CommitLog
from ..functions.arrays import label_with_offset
from ..functions.hashing import hash_word, normal_vector, uniform_int
from ..operators.feed import assign_batches, head_per_batch, shuffle_records, split_towers, take_batches
from ..operators.metriclog import metric_rows
from ..operators.quality import classifier_score, frechet_distance
from ..operators.raster import decode_image, montage_sheets, resize_bilinear
from ..operators.scoring import generate_samples, score
from ..session import store
from ..sources import register


def read_images(
    spark: SparkSession, path: str, image_bytes: int, label_offset: int = 0, extra: str = "", **options: str
) -> DataFrame:
    """Images in [-1, 1] and INT labels from record files; a record of another size is an error.

    ``_shard`` and ``_offset`` identify a record, and ``record`` is both in one text, so the result can be
    interleaved by (``_shard``, ``_offset``) and shuffled by ``record`` whatever the files hold.
    """
    register(spark)
    schema = f"image_raw BINARY NOT NULL, label BIGINT NOT NULL, _shard STRING, _offset BIGINT{', ' + extra if extra else ''}"
    records = spark.read.format("tfrecord").schema(schema).options(imageBytes=str(image_bytes), **options).load(path)
    return records.withColumns({
        "image": decode_image(F.col("image_raw"), image_bytes),
        "label": label_with_offset(F.col("label"), label_offset),
        "record": F.concat_ws(":", "_shard", F.col("_offset").cast("string")),
    }).drop("image_raw")


class Sorted:
    """Records sorted into good and bad ones: ``write`` scans record files once, ``good`` and ``bad`` read what it wrote.

    Both parts are written by the same tasks in the same job, and one commit makes them visible together. Writing again
    makes a new pair; readers go on with the newest, or with the commit they name.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def write(self, source: str, image_bytes: int, extra: str = "", **options: str) -> int:
        """Reads the record files below ``source``; returns the number of the commit.

        A record whose payload is damaged, lacks a feature or has an image of another size is a bad one. Damage to
        the framing, after which no record of the file can be found, is still an error.
        """
        register(self.spark)
        columns = f"image_raw BINARY, label BIGINT{', ' + extra if extra else ''}, _shard STRING, _offset BIGINT, _corrupt_record BINARY, _reason STRING"
        reader = self.spark.read.format("tfrecord").schema(columns).options(imageBytes=str(image_bytes), mode="PERMISSIVE", **options)
        folder = uuid.uuid4().hex
        records = reader.load(source).withColumn("bad", F.col("_reason").isNotNull())
        records.write.partitionBy("bad").parquet(f"{self.path}/data/{folder}")
        names = [f.name for f in records.schema if f.name not in ("bad", "_corrupt_record", "_reason")]
        number = self.log.newest() + 1
        self.log.commit(number, {"folder": folder, "good": names, "schema": records.drop("bad").schema.jsonValue()})
        return number

    def _part(self, bad: bool, number: int | None) -> tuple[DataFrame, dict]:
        number = self.log.newest() if number is None else number
        if number < 0:
            raise ValueError(f"nothing has been written to {self.path}")
        value = self.log.read(number)
        schema = T.StructType.fromJson(value["schema"]).add("bad", T.BooleanType())
        # The folder of both parts can be read even if one has no rows; the filter prunes the other one.
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data/{value['folder']}")
        return rows.where(F.col("bad") == bad).drop("bad"), value

    def good(self, number: int | None = None) -> DataFrame:
        """The decoded features, and where each record comes from."""
        rows, value = self._part(False, number)
        return rows.select(*value["good"])

    def bad(self, number: int | None = None) -> DataFrame:
        """(shard, offset, reason, payload) of the records that can't be used."""
        rows, _ = self._part(True, number)
        named = {"shard": "_shard", "offset": "_offset", "reason": "_reason", "payload": "_corrupt_record"}
        return rows.select(*[F.col(c).alias(name) for name, c in named.items()])


def training_feed(
    records: DataFrame,
    record: str,
    epochs: int,
    batch_size: int,
    num_towers: int,
    z_dim: int,
    num_classes: int,
    seed: int = 0,
    drop_remainder: bool = True,
) -> DataFrame:
    """Shuffled, repeated, batched and split over towers, with noise and a fake label beside each row.

    Batches run across epoch borders. Noise and fake labels are drawn from (seed, rank), so each epoch
    gets its own. Shuffling decides on the order alone; noise is computed where the rows end up.
    """
    ranked = shuffle_records(records, record, seed, epochs, total="_total")
    batched = assign_batches(ranked, batch_size, drop_remainder, total="_total").drop("_total", "shuffle_key")
    return split_towers(batched, num_towers).withColumns({
        "z": normal_vector(seed, F.col("rank"), z_dim),
        "fake_label": uniform_int(hash_word(seed, "class", F.col("rank")), num_classes),
    })


def write_feed(feed: DataFrame, path: str, steps_per_folder: int, files: int) -> None:
    """Feed as Parquet, one folder per range of steps, rows of a step together and in order."""
    step_range = F.call_function("div", F.col("step_id"), F.lit(steps_per_folder))
    laid_out = feed.withColumn("step_range", step_range).repartitionByRange(files, "step_id", "tower_id", "position")
    ordered = laid_out.sortWithinPartitions("step_range", "step_id", "tower_id", "position")
    ordered.write.partitionBy("step_range").parquet(path)


def grid_size(n: int) -> tuple[int, int]:
    """(height, width) of the most square grid of n tiles; see ``images.squarest_grid``."""
    width = max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)
    return n // width, width


def contact_sheets(batched: DataFrame, image: str, height: int, width: int, channels: int, show: int) -> DataFrame:
    """One sheet per batch with its first ``show`` images: (batch_id, height, width, canvas)."""
    rows, cols = grid_size(show)
    return montage_sheets(
        head_per_batch(batched, show), image, "position", ["batch_id"], height, width, channels, rows, cols
    )


def draw_sample(records: DataFrame, record: str, batch_size: int, num_batches: int, seed: int = 0) -> DataFrame:
    """``num_batches`` whole batches of shuffled records; too few records are an error."""
    ranked = shuffle_records(records, record, seed)
    return take_batches(ranked, batch_size, num_batches, records.select(record).count())


def evaluate(
    real: DataFrame,
    row: str,
    image: str,
    shape: tuple[int, int, int],
    make_classifier: Callable[[], Callable],
    make_generator: Callable[[], Callable],
    z_dim: int,
    num_classes: int,
    classifier_size: int | None = None,
    seed: int = 0,
    step: int = 0,
) -> DataFrame:
    """``fid`` and ``incscore`` as (step, name, value) rows.

    The generator returns an ``image`` of ``shape`` (height, width, channels) for noise and a class; as
    many are made as there are real rows. The classifier returns ``pool`` and ``logits`` for an image,
    resized to ``classifier_size`` squared if given. Both sides go through the models once, together; pools
    and logits are written to the scratch folder and both metrics read them there, so that they describe the
    same samples even if a model isn't deterministic.
    """
    generated = generate_samples(real, row, make_generator, z_dim, num_classes, ["image"], seed)

    def classify(images: DataFrame) -> DataFrame:
        size = shape
        if classifier_size is not None:
            size = (classifier_size, classifier_size, shape[2])
            images = images.withColumn("image", resize_bilinear(F.col("image"), *shape, *size[:2]))
        return score(images, make_classifier, {"image": math.prod(size)}, ["pool", "logits"])

    images = real.select(F.col(image).alias("image"), F.lit(False).alias("is_generated")).unionByName(
        generated.select("image", F.lit(True).alias("is_generated"))
    )
    scored = store(classify(images).select("pool", "logits", "is_generated"), "scores")
    at = F.lit(step).cast("bigint").alias("step")
    fid = frechet_distance(scored, "pool", "is_generated").select(at, F.col("frechet_distance").alias("fid"))
    incscore = classifier_score(scored.filter("is_generated"), "logits").select(at, F.col("classifier_score").alias("incscore"))
    return metric_rows(fid, "step", ["fid"]).unionByName(metric_rows(incscore, "step", ["incscore"]))
