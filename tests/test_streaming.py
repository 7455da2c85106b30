"""Streams end in the state that a batch over the same rows gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplewright.operators import moments, quality
from samplewright.streaming.metriclog import start_metric_log
from samplewright.streaming.moving import read_moving_moments, start_moving_moments
from samplewright.streaming.snapshots import SnapshotMetrics, read_metrics

RNG = np.random.default_rng(5)


def _stream(spark, schema, path):
    options = {"maxFilesPerTrigger": "1", "recursiveFileLookup": "true"}
    return spark.readStream.schema(schema).options(**options).parquet(path)


def _drop(df, path, name):
    df.coalesce(1).write.parquet(f"{path}/{name}")


def test_moving_moments_stream_equals_batch(spark, sf_dir, tmp_path):
    """All days, the last one too, and rows of a day that come in different files and out of order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.unix_date(F.to_date("ts")).alias("day"), "event_type", "value"
    )
    source, state, checkpoint = (str(tmp_path / d) for d in ("in", "state", "checkpoint"))
    middle = F.lit(19733)  # 2024-01-11
    late = F.pmod(F.xxhash64("value"), F.lit(5)) == 0
    _drop(events.filter((F.col("day") >= middle) & ~late), source, "a")
    _drop(events.filter((F.col("day") < middle) & ~late), source, "b")

    def run():
        stream = _stream(spark, events.schema, source)
        start_moving_moments(stream, ["event_type"], "day", "value", state, checkpoint).awaitTermination()

    run()
    # A second run takes up where the first ended.
    _drop(events.filter(late), source, "c")
    run()
    got = {r.event_type: r for r in read_moving_moments(spark, state, ["event_type"], "day").collect()}
    days = events.groupBy("event_type", "day").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
    wanted = moments.moving_moments(days, "day", ["event_type"]).collect()
    assert len(wanted) == len(got)
    for want in wanted:
        row = got[want.event_type]
        assert row.batches == want.batches
        assert np.allclose((row.moving_mean, row.moving_variance), (want.moving_mean, want.moving_variance))


SAMPLES = "snapshot int, is_generated boolean, feature array<double>, logits array<double>"


def _samples(spark, snapshots, n=30):
    rows = []
    for s in snapshots:
        for i in range(2 * n):
            rows.append((s, i % 2 == 1, (RNG.normal(size=3) + s).tolist(), RNG.normal(size=4).tolist()))
    return spark.createDataFrame(rows, SAMPLES)


def test_snapshot_metrics_equal_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    samples = _samples(spark, [0, 1, 2]).withColumn("at", F.monotonically_increasing_id()).cache()
    # Snapshot 0 arrives in two files; snapshot 2 is still incomplete at the end.
    part = F.when(F.col("snapshot") == 0, F.pmod("at", F.lit(2))).when(F.col("snapshot") == 1, 1).otherwise(2)
    for p in (0, 1, 2):
        chosen = samples.filter(part == p)
        _drop((chosen.limit(41) if p == 2 else chosen).drop("at"), source, f"f{p}")
    stream = _stream(spark, samples.drop("at").schema, source)
    metrics = SnapshotMetrics(stream, "snapshot", "feature", "logits", expected=30, path=out)
    metrics.start(checkpoint).awaitTermination()
    got = {r.snapshot: r for r in read_metrics(spark, out).collect()}
    assert set(got) == {0, 1}
    for s in (0, 1):
        rows = samples.filter(F.col("snapshot") == s)
        assert np.isclose(got[s].frechet_distance, quality.frechet_distance(rows, "feature", "is_generated").first().frechet_distance)
        score = quality.classifier_score(rows.filter("is_generated"), "logits").first().classifier_score
        assert np.isclose(got[s].classifier_score, score)
        assert (got[s].n_real, got[s].n_generated) == (30, 30)


def test_snapshot_batch_can_run_twice_and_surplus_rows_fail(spark, tmp_path):
    samples = _samples(spark, [4])
    metrics = SnapshotMetrics(samples, "snapshot", "feature", "logits", expected=30, path=str(tmp_path))
    half = samples.limit(30).cache()
    rest = samples.exceptAll(half)
    metrics.add(half, 0)
    metrics.add(half, 0)
    assert read_metrics(spark, str(tmp_path)).count() == 0
    metrics.add(rest, 1)
    metrics.add(rest, 1)
    row = read_metrics(spark, str(tmp_path)).first()
    assert np.isclose(row.frechet_distance, quality.frechet_distance(samples, "feature", "is_generated").first().frechet_distance)
    with pytest.raises(ValueError, match="more than 30 samples for snapshot 4"):
        metrics.add(half, 2)


def test_metric_log_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    metrics = spark.range(1000).select(F.col("id").alias("step"), F.lit("d_loss").alias("name"), F.rand(1).alias("value"))
    _drop(metrics.filter("step < 500"), source, "a")
    for name in ("b", None):
        start_metric_log(_stream(spark, metrics.schema, source), out, checkpoint, stop_at=900).awaitTermination()
        if name:
            _drop(metrics.filter("step >= 500"), source, name)
    assert sorted(r.step for r in spark.read.parquet(out).collect()) == [0, 200, 400, 600, 800]
