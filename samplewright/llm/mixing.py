"""Mixing sources to target weights by weighted sampling without replacement, with SQL functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .text import SPACES, unit_hash

#: Sources above this number are joined by shuffle instead of being broadcast.
MAX_BROADCAST_SOURCES = 10_000
#: Rows that one window partition of the sampling order is meant to hold.
ROWS_PER_BUCKET = 2_000
#: Parts of an octave of keys whose rows are counted before they are cut into buckets.
_CELLS = 16

_JUNK = "#$%&*|!+=<>{}[]~^@\\"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than the six ASCII white-space characters; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_quality(text: Column) -> Column:
    """A weight in [0.1, 1]: the share of characters that are not symbols, at least 0.1."""
    whole = F.coalesce(text, F.lit(""))
    clean = F.length(F.translate(whole, _JUNK, "")) / F.greatest(F.length(whole), F.lit(1))
    return F.greatest(F.lit(0.1), clean)


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float
) -> DataFrame:
    """Adds ``target`` to (source, source_size, n_rows).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes;
    a target stops at ``most_epochs`` times its source's size and the excess is shared by weight among the
    others, until none is above. That is the level at which the capped targets add up to the whole: with
    sources ordered by the level at which they reach their cap, the level is found from running sums.
    Works on one row per source.
    """
    if share > most_epochs:
        raise ValueError("share must not be above most_epochs: the targets could not be reached")
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_cap = everything.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    ranked = weighed.withColumn("ratio", F.col("cap") / F.col("w"))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return ranked.select(
        "source", "source_size", "n_rows", F.least(F.col("cap"), F.col("w") * F.coalesce(water, F.lit(0.0))).alias("target")
    )


def with_buckets(rows: DataFrame) -> DataFrame:
    """Adds (cell, step) to rows (source, key, ...): buckets of about ROWS_PER_BUCKET rows of a source, in key order.

    Inside a cell, a sixteenth of an octave, keys are spread almost evenly, and even steps cut it into buckets.
    """
    place = F.log2(F.greatest(F.col("key"), F.lit(1e-300))) * _CELLS
    rows = rows.withColumn("cell", F.floor(place).cast("int"))
    cells = rows.groupBy("source", "cell").agg(F.ceil(F.count("*") / F.lit(ROWS_PER_BUCKET)).alias("steps"))
    cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), "steps")
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    step = F.least(F.floor((place - F.col("cell")) * F.col("steps")), F.col("steps") - 1)
    return rows.withColumn("step", step.cast("long")).drop("s", "c", "steps")


def mix_sources(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: float = 2.0,
    quality: Column | None = None,
    seed: int = 1,
) -> DataFrame:
    """How often each document goes into the mix: (id, text_key, size, source, source_size, target, copies, taken).

    Each source gets a target (``source_targets``). Complete epochs of a source come first; the rest of its
    target is filled by sampling without replacement with probability in proportion to quality: a
    document's key is an exponential variable divided by its quality, documents are sorted by key inside
    their source, and sizes are summed up to the rest. A document on the limit is taken if more than half
    of it fits. Keys are digests of (seed, id, size), so reruns agree.

    Running sums are taken inside buckets that follow the key order, and offset by the sums of the buckets
    before, so that no window holds a source. Rows are counted by source and cell of the key's logarithm, and each
    cell is cut into as many even steps as its rows ask for: whatever the qualities of a source, buckets are small.

    Null and empty texts have size 0. A source of size 0 has target 0. Null is a source like others, the
    last. Repeated rows are rows of their own; text_key is a hash of the text. Other columns are ignored. An empty table gives none.
    """
    weight = text_quality(F.col(text_col)) if quality is None else quality
    base = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text_col).alias("text_key"),
        word_count(F.col(text_col)).alias("size"),
        F.greatest(weight, F.lit(1e-6)).alias("quality"),
    )
    exponential = -F.log(unit_hash(seed, F.col("id"), F.col("size")))
    base = store(base.withColumn("key", exponential / F.col("quality")), "mixing")

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sizes, weights, share, most_epochs)
    small = targets.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    side = targets.select(F.col("source").alias("s"), "source_size", "n_rows", "target")
    side = F.broadcast(side) if small else side
    planned = base.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(0)
    planned = planned.withColumn("epochs", epochs.cast("long"))
    planned = planned.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    planned = with_buckets(planned)

    in_source = Window.partitionBy("source").orderBy("cell", "step")
    offsets = planned.groupBy("source", "cell", "step").agg(F.sum("size").alias("bucket_size"))
    offsets = offsets.select(
        F.col("source").alias("s"),
        F.col("cell").alias("c"),
        F.col("step").alias("t"),
        (F.sum("bucket_size").over(in_source) - F.col("bucket_size")).alias("offset"),
    )
    bucket = Window.partitionBy("source", "cell", "step")
    in_bucket = bucket.orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inner = planned.withColumn("upto", F.sum("size").over(in_bucket))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")) & (F.col("step") == F.col("t"))
    summed = inner.join(offsets, same, "left")
    middle = F.col("offset") + F.col("upto") - F.col("size") / 2
    copies = F.col("epochs") + F.when((F.col("rest") > 0) & (middle <= F.col("rest")), 1).otherwise(0)
    return summed.select(
        F.col("id").alias(id_col), "text_key", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )
