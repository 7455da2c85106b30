"""Turning labelled records into shuffled, repeated, batched sample sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.arrays import whole_div
from ..functions.hashing import hash_key
from .ranking import bucket_bits, bucketed_rank, hash_bucket, ordered_rank


def interleave_shards(df: DataFrame, shard: str, record: str, cycle_length: int, seed: int = 0) -> DataFrame:
    """Round-robins records over ``cycle_length`` shards at a time.

    Shards are taken in hash order. Adds ``cycle``, ``slot`` (shard within the cycle), ``pos`` (record
    within the shard) and ``seq``, the position in the interleaved order (cycle, pos, slot). ``seq``
    follows from the shard lengths alone, so the rows are never sorted by it.
    """
    # One row per file from here to `shards`, so plain windows will do.
    lengths = df.groupBy(shard).agg(F.count(F.lit(1)).alias("_length"))
    keyed = lengths.withColumn("_key", hash_key(seed, "shards", F.col(shard).cast("string")))
    place = F.row_number().over(Window.orderBy("_key", shard)) - 1
    placed = keyed.withColumn("_place", place).select(
        shard,
        "_length",
        whole_div(F.col("_place"), cycle_length).alias("cycle"),
        (F.col("_place") % cycle_length).cast("int").alias("slot"),
    )
    earlier_cycles = Window.orderBy("cycle").rangeBetween(Window.unboundedPreceding, -1)
    shards = placed.select(
        shard,
        "cycle",
        "slot",
        F.coalesce(F.sum("_length").over(earlier_cycles), F.lit(0)).alias("_start"),
        F.collect_list(F.struct("slot", "_length")).over(Window.partitionBy("cycle")).alias("_lengths"),
    )

    ranked = ordered_rank(df, record, group=[shard], rank="pos", per_group=shards)
    # Records already out before round `pos`, and in this round from earlier slots.
    out_before = F.aggregate(
        "_lengths",
        F.lit(0).cast("bigint"),
        lambda acc, s: acc
        + F.least(s["_length"], F.col("pos"))
        + F.when((s["slot"] < F.col("slot")) & (s["_length"] > F.col("pos")), 1).otherwise(0),
    )
    return ranked.withColumn("seq", F.col("_start") + out_before).drop("_lengths", "_start")


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch, with an ``epoch`` column."""
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def shuffle_records(
    df: DataFrame,
    record: str,
    seed: int,
    epochs: int = 1,
    total: str | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Full shuffle, drawn anew for each epoch; ``rank`` runs on across epochs.

    Adds ``epoch``, ``shuffle_key`` and ``rank``. Unlike a bounded shuffle buffer it mixes the whole
    table and gives the same order on every run.
    """
    repeated = repeat_epochs(df, epochs)
    keyed = repeated.withColumn("shuffle_key", hash_key(seed, "shuffle", F.col("epoch"), F.col(record)))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("shuffle_key"), bits or bucket_bits(df)))
    ranked = bucketed_rank(keyed, "_bucket", ["shuffle_key", record], group=["epoch"], rank="_within", total="_rows")
    # Every epoch holds every row once.
    ranked = ranked.withColumn("rank", F.col("epoch") * F.col("_rows") + F.col("_within"))
    if total is not None:
        ranked = ranked.withColumn(total, F.col("_rows") * epochs)
    return ranked.drop("_rows", "_within")


def assign_batches(ranked: DataFrame, batch_size: int, drop_remainder: bool = False, total: str | None = None) -> DataFrame:
    """Consecutive ranks in batches: adds ``batch_id`` and ``position`` within the batch.

    ``drop_remainder`` leaves out a short last batch and needs the row count in column ``total``.
    """
    out = ranked.withColumns({
        "batch_id": whole_div(F.col("rank"), batch_size),
        "position": (F.col("rank") % batch_size).cast("int"),
    })
    if drop_remainder:
        if total is None:
            raise ValueError("drop_remainder needs the name of a row-count column")
        out = out.filter(F.col("rank") < whole_div(F.col(total), batch_size) * batch_size)
    return out


def split_towers(batched: DataFrame, num_towers: int) -> DataFrame:
    """Every ``num_towers`` consecutive batches make a step, one batch per tower."""
    return batched.withColumns({
        "step_id": whole_div(F.col("batch_id"), num_towers),
        "tower_id": (F.col("batch_id") % num_towers).cast("int"),
    })


def take_batches(ranked: DataFrame, batch_size: int, num_batches: int, available: int) -> DataFrame:
    """Exactly the first ``num_batches`` batches; too few available rows are an error."""
    if available < batch_size * num_batches:
        raise ValueError(f"{num_batches} batches of {batch_size} asked for, only {available} rows")
    return assign_batches(ranked.filter(F.col("rank") < batch_size * num_batches), batch_size)


def head_per_batch(batched: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every batch."""
    return batched.filter(F.col("position") < n)


def rank_by_score(batched: DataFrame, score: str, record: str, batch_size: int, stop_at: int | None = None) -> DataFrame:
    """Ascending score order inside each batch, and the export name of each row.

    Adds ``place`` (0-based), ``counter`` (running over all batches) and ``name``. A batch is one
    window partition, so its size is bounded by ``batch_size``. ``stop_at`` keeps the batches that
    begin before that counter.
    """
    if stop_at is not None:
        batched = batched.filter(F.col("batch_id") * batch_size < stop_at)
    order = Window.partitionBy("batch_id").orderBy(score, record)
    ranked = batched.withColumn("place", (F.row_number().over(order) - 1).cast("int"))
    counter = F.col("batch_id") * batch_size + F.col("place")
    ranked = ranked.withColumn("counter", counter.cast("bigint"))
    return ranked.withColumn("name", export_name(F.col("counter")))


def export_name(counter: Column) -> Column:
    """First thousand: a letter a..j, the counter, '.png'; after that 'fake' and the counter from 0."""
    letter = F.char(F.lit(97) + counter % 10)
    named = F.concat(letter, counter.cast("string"), F.lit(".png"))
    late = F.concat(F.lit("fake"), (counter - 1000).cast("string"), F.lit(".png"))
    return F.when(counter < 1000, named).otherwise(late)


def accumulate(runs: Sequence[DataFrame]) -> DataFrame:
    """All rows of all runs, columns matched by name."""
    if not runs:
        raise ValueError("nothing to accumulate")
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out
