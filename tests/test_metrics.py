"""Losses, moments and quality metrics against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.operators import losses, metriclog, moments, quality


def frame(spark, x, **columns):
    rows = [(i, v.tolist(), *(c[i] for c in columns.values())) for i, v in enumerate(x)]
    types = "".join(f", {name} {'boolean' if isinstance(c[0], bool) else 'int'}" for name, c in columns.items())
    return spark.createDataFrame(rows, f"id int, v array<double>{types}").repartition(6)


def assembled(spark_rows, size):
    cov = np.full((size, size), np.nan)
    for r in spark_rows:
        cov[r.i, r.j] = cov[r.j, r.i] = r["cov"]
    return cov


@pytest.mark.parametrize("size", [1, 64, 300])
def test_covariance_matches_numpy(spark, size):
    # 300 is more than one tile; the large mean would ruin plain sums of squares.
    x = np.random.default_rng(size).normal(size=(400, size)) + 1e6
    made = moments.vector_moments(frame(spark, x), "v")
    cov = assembled(moments.covariances(made).collect(), size)
    assert np.allclose(cov, np.cov(x.T).reshape(size, size), rtol=1e-6, atol=1e-9)
    mean = {r.i: r["mean"] for r in moments.means(made).collect()}
    assert np.allclose([mean[i] for i in range(size)], x.mean(axis=0))


def test_moments_of_parts_merge(spark):
    x = np.random.default_rng(0).normal(size=(300, 5))
    df = frame(spark, x, part=[i % 3 for i in range(300)])
    parts = [moments.vector_moments(df.filter(F.col("part") == p), "v") for p in range(3)]
    whole = moments.merge_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert np.allclose(assembled(moments.covariances(whole).collect(), 5), np.cov(x.T))


def test_moments_flush_when_keys_are_many(spark, monkeypatch):
    monkeypatch.setattr(moments, "FOLD_BYTES", 100)
    x = np.random.default_rng(0).normal(size=(200, 4))
    key = [i % 20 for i in range(200)]
    made = moments.vector_moments(frame(spark, x, key=key), "v", ["key"])
    for k in (0, 7):
        rows = moments.covariances(made, ["key"]).filter(F.col("key") == k).collect()
        assert np.allclose(assembled(rows, 4), np.cov(x[np.array(key) == k].T))


def test_ragged_vectors_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<double>")
    for parts in (1, 2):
        with pytest.raises(PySparkException, match="ragged|different lengths"):
            moments.vector_moments(df.repartition(parts, "id"), "v").collect()
    with pytest.raises(PySparkException, match="ragged"):
        quality.classifier_score(df, "v").collect()


def _frechet(a, b):
    values, vectors = np.linalg.eig(np.cov(a.T) @ np.cov(b.T))
    gap = a.mean(axis=0) - b.mean(axis=0)
    root = np.sqrt(np.clip(values.real, 0, None)).sum()
    return gap @ gap + np.trace(np.cov(a.T)) + np.trace(np.cov(b.T)) - 2 * root


@pytest.mark.parametrize("size", [2, 64])
def test_frechet_distance_matches_numpy(spark, size):
    rng = np.random.default_rng(size)
    real, fake = rng.normal(size=(500, size)), rng.normal(size=(300, size)) * 1.5 + 0.3
    df = frame(spark, np.vstack([real, fake]), fake=[False] * 500 + [True] * 300)
    row = quality.frechet_distance(df, "v", "fake").first()
    assert (row.n_real, row.n_generated) == (500, 300)
    assert np.isclose(row.frechet_distance, _frechet(real, fake), rtol=1e-8)
    swapped = quality.frechet_distance(df.withColumn("fake", ~F.col("fake")), "v", "fake").first()
    assert np.isclose(row.frechet_distance, swapped.frechet_distance)


def test_frechet_of_a_set_with_itself_is_zero(spark):
    x = np.random.default_rng(1).normal(size=(200, 8))
    df = frame(spark, np.vstack([x, x]), fake=[False] * 200 + [True] * 200)
    assert abs(quality.frechet_distance(df, "v", "fake").first().frechet_distance) < 1e-9


def test_frechet_with_one_side_missing_is_null(spark):
    df = frame(spark, np.ones((5, 2)), fake=[True] * 5)
    assert quality.frechet_distance(df, "v", "fake").first().frechet_distance is None


def _score(logits):
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return np.exp(np.mean(np.sum(p * (np.log(p) - np.log(p.mean(axis=0))), axis=1)))


def test_classifier_score_matches_numpy_and_its_bounds(spark):
    logits = np.random.default_rng(2).normal(size=(400, 12)) * 3
    score = quality.classifier_score(frame(spark, logits), "v").first()
    assert score.n == 400
    assert np.isclose(score.classifier_score, _score(logits), rtol=1e-10)
    assert 1 <= score.classifier_score <= 12
    certain = np.eye(4).repeat(10, axis=0) * 1000.0
    assert np.isclose(quality.classifier_score(frame(spark, certain), "v").first().classifier_score, 4.0)


def test_losses(spark):
    x = np.random.default_rng(3).normal(size=300) * 2
    real = [bool(i % 3) for i in range(300)]
    df = spark.createDataFrame([(float(a), b) for a, b in zip(x, real)], "x double, real boolean")
    side = np.array(real)
    hinge = losses.losses(df, "x", F.col("real")).first()
    assert np.isclose(hinge.d_loss_real, np.maximum(1 - x[side], 0).mean())
    assert np.isclose(hinge.d_loss_fake, np.maximum(1 + x[~side], 0).mean())
    assert np.isclose(hinge.g_loss, -x[~side].mean())
    assert np.isclose(hinge.d_loss, hinge.d_loss_real + hinge.d_loss_fake)
    kl = losses.losses(df, "x", F.col("real"), "kl_loss").first()
    assert np.isclose(kl.d_loss_real, np.logaddexp(0, -x[side]).mean())
    assert np.isclose(kl.d_loss_fake, np.logaddexp(0, x[~side]).mean())
    with pytest.raises(NotImplementedError):
        losses.losses(df, "x", F.col("real"), "wasserstein")


def test_moving_moments_equal_the_sequential_update(spark):
    rng = np.random.default_rng(4)
    rows = [(k, t, float(rng.normal()), float(rng.random())) for k in ("a", "b") for t in range(50)]
    batches = spark.createDataFrame(rows, "key string, t bigint, mean double, variance double").repartition(4)
    want = {}
    for k, _, m, s in rows:
        mean, var = want.get(k, (0.0, 1.0))
        want[k] = (mean * 0.9 + m * 0.1, var * 0.9 + s * 0.1)
    whole = moments.moving_moments(batches, "t", ["key"], decay=0.9)
    for r in whole.collect():
        assert np.allclose((r.moving_mean, r.moving_variance), want[r.key]) and r.batches == 50
    first = moments.moving_moments(batches.filter("t < 20"), "t", ["key"], decay=0.9)
    rest = moments.moving_moments(batches.filter("t >= 20"), "t", ["key"], decay=0.9, state=first)
    for r in rest.collect():
        assert np.allclose((r.moving_mean, r.moving_variance), want[r.key]) and r.batches == 50


def test_log_every(spark):
    wide = spark.range(1000).select(F.col("id").alias("step"), F.col("id").cast("double").alias("a"), F.lit(1).alias("b"))
    logged = metriclog.log_every(metriclog.metric_rows(wide, "step", ["a", "b"]), "step", every=200, stop_at=800)
    assert sorted((r.step, r.name, r.value) for r in logged.collect()) == sorted(
        [(s, "a", float(s)) for s in (0, 200, 400, 600)] + [(s, "b", 1.0) for s in (0, 200, 400, 600)]
    )


def test_empty_input(spark):
    none = spark.createDataFrame([], "v array<double>, fake boolean, x double")
    assert moments.vector_moments(none, "v").count() == 0
    assert quality.frechet_distance(none, "v", "fake").count() == 0
    assert quality.classifier_score(none, "v").first().classifier_score is None
    assert losses.losses(none, "x", F.col("fake")).first().d_loss is None


def test_nan_is_not_hidden(spark):
    x = np.random.default_rng(6).normal(size=(20, 3))
    x[7, 1] = np.nan
    df = frame(spark, x, fake=[bool(i % 2) for i in range(20)])
    assert quality.frechet_distance(df, "v", "fake").first().frechet_distance is None
    assert np.isnan(quality.classifier_score(df, "v").first().classifier_score)


@pytest.mark.parametrize("kind", ["null vector", "null inside"])
def test_missing_values_are_an_error(spark, kind):
    rows = [(1, [1.0, 2.0]), (2, None if kind == "null vector" else [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    for run in (moments.vector_moments, quality.score_parts):
        with pytest.raises(PySparkException, match=kind):
            run(df, "v").collect()


def test_neighbouring_keys_beside_a_null_stay_apart():
    import pyarrow as pa

    from samplewright.operators.kernels import group_rows

    big = 1 << 53
    keys = [big, big + 1, None, big + 1, big, None, 5]
    batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(["a", "a", "a", "b", "a", None, None])], ["k", "s"])
    got = {key: index.tolist() for key, index in group_rows(batch, 2)}
    assert got == {(big, "a"): [0, 4], (big + 1, "a"): [1], (None, "a"): [2], (big + 1, "b"): [3], (None, None): [5], (5, None): [6]}


def test_keyed_fold_is_bounded(spark, monkeypatch):
    """Many keys in one batch: what is held never exceeds the limit by more than one matrix."""
    from samplewright.operators import moments

    monkeypatch.setattr(moments, "FOLD_BYTES", 3 * 8 * 16 * 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i % 100, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>").coalesce(1)
    made = moments.vector_moments(df, "v", ["k"])
    got = {r.k: np.array(r.cross).reshape(16, 16) for r in made.collect()}
    for k in (0, 57, 99):
        rows = x[k::100] - x[k::100].mean(axis=0)
        assert np.allclose(got[k], rows.T @ rows)


def test_one_and_two_levels_of_merging_agree(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(300, 5)) + 100
    df = frame(spark, x).repartition(9)
    for limit in (1 << 60, -1):
        monkeypatch.setattr(moments, "ONE_LEVEL_BYTES", limit)
        row = moments.vector_moments(df, "v", fan_in=4).first()
        assert row.n == 300 and np.allclose(row.mean_i, x.mean(axis=0))
        assert np.allclose(np.reshape(row.cross, (5, 5)) / 299, np.cov(x.T))
