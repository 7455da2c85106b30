"""Commits, tables that runs append to, quarantined records, as-of joins, versions of moving statistics, evaluations that stop."""

import threading

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.commits import CommitConflict, CommitLog
from samplewright.operators import classes, linalg, moments, quality
from samplewright.operators.asof import as_of
from samplewright.operators.generate import with_weighted_class
from samplewright.operators.runs import RunTable
from samplewright.plans import jobs
from samplewright.sources import register
from samplewright.streaming.snapshots import EvaluationsDone, SnapshotMetrics, read_metrics

RNG = np.random.default_rng(5)


def test_a_commit_is_made_once(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path / "log")), CommitLog(spark, str(tmp_path / "log"))
    assert log.newest() == -1
    log.commit(0, {"by": "a"})
    with pytest.raises(CommitConflict):
        other.commit(0, {"by": "b"})
    with pytest.raises(CommitConflict):
        other.commit(2, {"by": "b"})
    # Both have seen commit 0 as the newest; the one that renames last fails, and leaves nothing.
    other.newest = lambda: 0
    log.commit(1, {"by": "a"})
    with pytest.raises(CommitConflict, match="another writer"):
        other.commit(1, {"by": "b"})
    assert [log.read(i)["by"] for i in range(log.newest() + 1)] == ["a", "a"]
    assert not list((tmp_path / "log").glob(".*.tmp"))


def test_two_writers_of_one_state(spark, tmp_path):
    w = RNG.normal(size=(12, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in w], "v array<double>")
    first = linalg.SpectralState(spark, str(tmp_path / "u"), size=4)
    second = linalg.SpectralState(spark, str(tmp_path / "u"), size=4)
    first.step(df, "v")
    stale = second.current()
    with pytest.raises(CommitConflict):
        second.step(df, "v")
    assert (second.version, second.current()) == (0, stale)
    assert second.refresh() == 1 and second.current() == first.current()
    second.step(df, "v", mode="frozen")
    second.step(df, "v")
    assert [r.version for r in second.table().orderBy("version").collect()] == [0, 1, 2]


def test_runs_replace_their_own_part(spark, tmp_path):
    runs = RunTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no run"):
        runs.read()
    ids = lambda n, at=0: spark.range(at, at + n).select("id", F.array(F.col("id") * 1.0).alias("v"))
    before = runs.append("a", ids(5))
    runs.append("b", ids(3, 100).select("v", "id"))
    runs.append("empty", ids(0))
    runs.append("a", ids(7))
    assert {r.run: r["count"] for r in runs.read().groupBy("run").count().collect()} == {"a": 7, "b": 3}
    assert sorted(r.id for r in runs.read(before).collect()) == [0, 1, 2, 3, 4]
    assert runs.runs() == ["a", "b", "empty"] and runs.runs(before) == ["a"]
    with pytest.raises(ValueError, match="differ in name or type"):
        runs.append("c", spark.range(2))
    with pytest.raises(ValueError, match="of their own"):
        runs.append("c", ids(1).withColumn("run", F.lit(1)))
    # A run that fails on the way changes nothing, and what it left is removed with what was replaced.
    with pytest.raises(PySparkException):
        runs.append("b", ids(3).withColumn("id", F.when(F.col("id") < 2, F.col("id")).otherwise(F.raise_error(F.lit("fails")).cast("bigint"))))
    assert runs.read().count() == 10
    assert runs.vacuum() >= 1 and runs.vacuum() == 0 and runs.read().count() == 10


def test_runs_of_several_writers(spark, tmp_path):
    def write(name):
        RunTable(spark, str(tmp_path / "t")).append(name, spark.range(4))

    RunTable(spark, str(tmp_path / "t")).append("0", spark.range(4))
    threads = [threading.Thread(target=write, args=(str(i),)) for i in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert RunTable(spark, str(tmp_path / "t")).runs() == ["0", "1", "2", "3", "4"]


def test_quarantine(spark, tmp_path):
    register(spark)
    source = tmp_path / "in"
    rows = [(bytes([i] * (8 if i != 3 else 7)), i) for i in range(40)]
    spark.createDataFrame(rows, "image_raw binary, label long").coalesce(2).write.format("tfrecord").mode("append").save(str(source))
    found = spark.read.format("tfrecord").schema("label bigint, _shard string, _offset bigint").load(str(source))
    hurt = found.filter("label = 11").first()
    data = bytearray(open(hurt._shard, "rb").read())
    data[hurt._offset + 14] ^= 0xFF
    open(hurt._shard, "wb").write(data)
    made = jobs.Sorted(spark, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="nothing"):
        made.good()
    assert made.write(str(source), image_bytes=8) == 0
    assert sorted(r.label for r in made.good().collect()) == [i for i in range(40) if i not in (3, 11)]
    assert made.good().columns == ["image_raw", "label", "_shard", "_offset"]
    bad = {(r.shard, r.offset): r for r in made.bad().collect()}
    assert sorted(r.reason for r in bad.values()) == ["bad payload checksum", "image_raw has 7 bytes, not 8"]
    assert bad[hurt._shard, hurt._offset].payload is not None
    assert made.write(str(source), image_bytes=7) == 1
    assert (made.good().count(), made.bad().count(), made.good(0).count()) == (1, 39, 38)


@pytest.mark.parametrize("cells", [None, 1, 50])
def test_as_of(spark, cells):
    rng = np.random.default_rng(3)
    stamps = {k: sorted(rng.choice(np.arange(-50, 1000), n, replace=False).tolist()) for k, n in (("a", 60), ("b", 3), ("c", 1))}
    versions = spark.createDataFrame([(k, v, f"{k}{v}") for k in stamps for v in stamps[k]], "k string, ver long, name string")
    asked = [(i, str(rng.choice(["a", "b", "c", "d"])), int(rng.integers(-100, 1200))) for i in range(500)] + [(500, None, 5), (501, "a", None)]
    rows = spark.createDataFrame(asked, "id long, k string, at long")
    got = {r.id: (r.ver, r.name) for r in as_of(rows, "at", versions, "ver", ["k"], cells=cells).collect()}
    for i, k, at in asked:
        last = max((v for v in stamps.get(k, []) if at is not None and v <= at), default=None)
        assert got[i] == (last, None if last is None else f"{k}{last}")
    inner = as_of(rows, "at", versions, "ver", ["k"], how="inner", cells=cells)
    assert {r.id for r in inner.collect()} == {i for i, (v, _) in got.items() if v is not None}


def test_as_of_without_keys_or_versions(spark):
    rows, none = spark.range(5), spark.createDataFrame([], "ver long, x string")
    assert [r.x for r in as_of(rows, "id", none, "ver").collect()] == [None] * 5
    versions = spark.createDataFrame([(2, "x"), (10**12, "y")], "ver long, x string")
    assert {r.id: r.x for r in as_of(rows, "id", versions, "ver").collect()} == {0: None, 1: None, 2: "x", 3: "x", 4: "x"}
    twice = spark.createDataFrame([(2, "x"), (2, "y")], "ver long, x string")
    with pytest.raises(PySparkException, match="two versions"):
        as_of(rows, "id", twice, "ver").collect()


@pytest.mark.parametrize("decay", [0.999, 0.5, 1e-30])
def test_moving_versions(spark, decay):
    steps = {"a": 700, "b": 3}
    rows = [(k, 5 * i, float(RNG.normal()), float(RNG.random())) for k, n in steps.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, step long, mean double, variance double").repartition(5)
    got = {(r.k, r.step): (r.moving_mean, r.moving_variance) for r in moments.moving_versions(df, "step", ["k"], decay).collect()}
    assert len(got) == len(rows)
    state = {}
    for k, step, m, v in rows:
        old = state.get(k, (0.0, 1.0))
        state[k] = (old[0] * decay + m * (1 - decay), old[1] * decay + v * (1 - decay))
        assert got[k, step] == pytest.approx(state[k], abs=1e-9)
    last = moments.moving_moments(df, "step", ["k"], decay).collect()
    assert {r.k: pytest.approx((r.moving_mean, r.moving_variance), abs=1e-9) for r in last} == state


def test_rows_before_the_first_version(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1)], "step long, v array<double>, c int")
    params = spark.createDataFrame([(1, [1.0], [0.0])], "c int, gamma array<double>, beta array<double>")
    versions = spark.createDataFrame([(3, 0, 0.0, 1.0)], "step long, channel int, moving_mean double, moving_variance double")
    with pytest.raises(PySparkException, match="no statistics yet at step 0"):
        classes.conditional_normalize_as_of(rows, "v", "c", params, "step", versions, 1).collect()
    with pytest.raises(PySparkException, match="channels are missing in version 3"):
        classes.conditional_normalize_as_of(rows.withColumn("step", F.lit(4)), "v", "c", params, "step", versions, 2).collect()


def test_classes_of_a_large_table(spark):
    weights = spark.range(3000).select(F.col("id").cast("int").alias("class_id"), (F.col("id") % 7).cast("double").alias("weight"))
    drawn = with_weighted_class(spark.range(5000), "id", weights, seed=3)
    assert drawn.count() == 5000 and drawn.filter("class_id % 7 = 0").count() == 0
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


SAMPLES = "snapshot int, is_generated boolean, feature array<double>, logits array<double>"


def test_evaluation_stops_and_goes_on(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    rows = [(s, i % 2 == 1, (RNG.normal(size=2) + s).tolist(), RNG.normal(size=3).tolist()) for s in range(3) for i in range(20)]
    samples = spark.createDataFrame(rows, SAMPLES).cache()
    # Snapshots 0 and 1 are complete at the same time.
    for part in ("snapshot = 1", "snapshot = 0", "snapshot = 2"):
        samples.filter(part).coalesce(1).write.mode("append").parquet(source)
    expected = samples.groupBy("snapshot", "is_generated").agg(F.count("*").alias("expected"))

    def live(stop_after, files=2):
        stream = spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", files).parquet(source)
        return SnapshotMetrics(stream, "snapshot", "feature", "logits", expected, out, stop_after)

    assert live(1).run(checkpoint, {"processingTime": "50 milliseconds"}) == 1
    assert [r.snapshot for r in read_metrics(spark, out).collect()] == [0]
    assert live(1).run(checkpoint, {"processingTime": "50 milliseconds"}) == 1
    assert live(5).run(checkpoint) == 3
    got = {r.snapshot: r.frechet_distance for r in read_metrics(spark, out).collect()}
    for s in range(3):
        want = quality.frechet_distance(samples.filter(F.col("snapshot") == s), "feature", "is_generated").first()
        assert np.isclose(got[s], want.frechet_distance)


def test_nothing_is_read_after_the_last_evaluation(spark, tmp_path):
    rows = [(0, i % 2 == 1, RNG.normal(size=2).tolist(), RNG.normal(size=3).tolist()) for i in range(8)]
    samples = spark.createDataFrame(rows, SAMPLES)
    metrics = SnapshotMetrics(samples, "snapshot", "feature", "logits", 4, str(tmp_path), stop_after=1)
    metrics.add(samples, 0)
    assert metrics.reported == 1
    with pytest.raises(EvaluationsDone):
        metrics.add(samples, 1)
    with pytest.raises(ValueError, match="stop_after"):
        SnapshotMetrics(samples, "snapshot", "feature", "logits", 4, str(tmp_path), stop_after=0)
