"""Projections, singular values, class lookups and attention against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.functions.arrays import vector_literal
from samplewright.operators import attention, classes, linalg, moments

RNG = np.random.default_rng(0)


def table(spark, matrix, name="v", key="row"):
    rows = [(i, row.tolist()) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} int, {name} array<double>").repartition(5)


def matrix_of(df, key, vector):
    return np.array([r[vector] for r in df.orderBy(key).collect()])


def test_projection_shipped_and_joined_agree(spark):
    x, w, b = RNG.normal(size=(40, 6)), RNG.normal(size=(6, 3)), RNG.normal(size=3)
    df, weights = table(spark, x, key="id"), table(spark, w, "w")
    want = x @ w + b
    assert np.allclose(matrix_of(linalg.linear_project(df, "v", weights, "out", b.tolist()), "id", "out"), want)
    bias = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "pos int, b double")
    assert np.allclose(matrix_of(linalg.project_by_join(df, "id", "v", weights, "out", bias), "id", "out"), want)


def test_projection_refuses_a_matrix_too_large_to_ship(spark, monkeypatch):
    monkeypatch.setattr(linalg, "MAX_SHIPPED_CELLS", 10)
    with pytest.raises(ValueError, match="project_by_join"):
        linalg.linear_project(table(spark, np.ones((2, 6)), key="id"), "v", table(spark, np.ones((6, 2)), "w"), "out")


def _power(w, u, iterations, eps=1e-12):
    for _ in range(iterations):
        v = u @ w.T
        v = v / (np.sqrt((v**2).sum()) + eps)
        u = v @ w
        u = u / (np.sqrt((u**2).sum()) + eps)
    return u, v @ w @ u


@pytest.mark.parametrize("iterations", [1, 3])
def test_power_iteration(spark, iterations):
    w = RNG.normal(size=(50, 7))
    u0 = RNG.normal(size=7)
    row = linalg.dominant_singular_value(table(spark, w), "v", vector_literal(u0), iterations).first()
    u, sigma = _power(w, u0, iterations)
    assert np.allclose(row.u, u) and np.isclose(row.sigma, sigma)
    assert row.sigma <= np.linalg.norm(w)


def test_warm_start_converges_and_modes(spark, tmp_path):
    w = RNG.normal(size=(30, 4)) * np.array([5.0, 2.0, 1.0, 0.5])
    df = table(spark, w).cache()
    state = linalg.SpectralState(spark, str(tmp_path / "u"), size=4)
    start = state.current()
    sigma, u = state.step(df, "v", mode="frozen")
    assert state.current() == start
    _, deferred = state.step(df, "v", mode="deferred")
    assert state.current() == start and np.allclose(deferred, u)
    state.commit(deferred)
    assert np.allclose(state.current(), u)
    for _ in range(6):
        sigma, _ = state.step(df, "v")
    assert np.isclose(sigma, np.linalg.svd(w, compute_uv=False)[0], rtol=1e-3)
    resumed = linalg.SpectralState(spark, str(tmp_path / "u"), size=4)
    assert resumed.version == state.version and resumed.current() == state.current()
    with pytest.raises(ValueError, match="unknown mode"):
        state.step(df, "v", mode="sometimes")


@pytest.mark.parametrize("iterations", [1, 4])
def test_class_map_rescaled_by_transpose(spark, iterations):
    e = RNG.normal(size=(6, 9))
    got = linalg.rescale_map(table(spark, e, "vec").withColumn("u", F.lit(1.0)), "vec", "u", iterations)
    u, sigma = _power(e.T, np.ones(6), iterations)
    assert np.allclose(matrix_of(got, "row", "vec"), e / sigma)
    assert np.allclose([r.u for r in got.orderBy("row").collect()], u)


def test_aligned_mean_checks_its_input(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [1.0])], "name string, v array<double>")
    got = {r.name: r["mean"] for r in linalg.aligned_vector_mean(df, "name", "v").collect()}
    assert got == {"a": [2.0, 4.0], "b": [1.0]}
    with pytest.raises(PySparkException, match="do not line up for b"):
        linalg.aligned_vector_mean(df, "name", "v", contributors=2).collect()
    ragged = df.union(spark.createDataFrame([("a", [1.0])], df.schema))
    with pytest.raises(PySparkException, match="do not line up for a"):
        linalg.aligned_vector_mean(ragged, "name", "v").collect()


def test_conditional_normalize(spark):
    x = RNG.normal(size=(30, 12)) * 3 + 1  # 4 positions, 3 channels
    label = RNG.integers(0, 2, size=30)
    gamma, beta = RNG.normal(size=(2, 3)), RNG.normal(size=(2, 3))
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], "id int, v array<double>, c int")
    params = spark.createDataFrame([(i, gamma[i].tolist(), beta[i].tolist()) for i in range(2)], "c int, gamma array<double>, beta array<double>")
    cube = x.reshape(30, 4, 3)
    mean, var = cube.mean(axis=(0, 1)), cube.var(axis=(0, 1))
    want = (cube - mean) / np.sqrt(var + 1e-5) * gamma[label][:, None] + beta[label][:, None]
    got = matrix_of(classes.conditional_normalize(df, "v", "c", params, 3), "id", "normalized")
    assert np.allclose(got, want.reshape(30, 12))
    moving = spark.createDataFrame([(c, 0.5, 2.0) for c in range(3)], "channel int, mean double, variance double")
    want = (cube - 0.5) / np.sqrt(2.0 + 1e-5) * gamma[label][:, None] + beta[label][:, None]
    got = matrix_of(classes.conditional_normalize(df, "v", "c", params, 3, moving), "id", "normalized")
    assert np.allclose(got, want.reshape(30, 12))
    plain = matrix_of(classes.normalize(df, "v", 3), "id", "normalized")
    assert np.allclose(plain, ((cube - mean) / np.sqrt(var + 1e-5)).reshape(30, 12))


def test_unknown_class_fails_or_is_listed(spark):
    df = spark.createDataFrame([(1, 0), (2, 9)], "id int, c int")
    params = spark.createDataFrame([(0, "x")], "c int, p string")
    with pytest.raises(PySparkException, match="unknown class 9"):
        classes.lookup_class(df, "c", params).collect()
    assert classes.lookup_class(df, "c", params, fail_on_unknown=False).count() == 2
    assert [r.id for r in classes.unknown_classes(df, "c", params).collect()] == [2]


def _attend(q, k, v):
    s = q @ k.T
    a = np.exp(s - s.max(axis=1, keepdims=True))
    return (a / a.sum(axis=1, keepdims=True)) @ v


@pytest.mark.parametrize("block_rows", [1000, 16, 1])
def test_attention_with_a_hot_group(spark, block_rows):
    # One group holds a third of the queries and half of the keys.
    sizes = {"hot": (40, 60), "a": (50, 30), "b": (30, 30)}
    rows_q, rows_k, want = [], [], {}
    for name, (nq, nk) in sizes.items():
        q, k, v = RNG.normal(size=(nq, 5)) * 4, RNG.normal(size=(nk, 5)), RNG.normal(size=(nk, 3))
        out = _attend(q, k, v)
        for i in range(nq):
            want[len(rows_q)] = out[i]
            rows_q.append((name, len(rows_q), q[i].tolist()))
        rows_k += [(name, len(rows_k) + i, k[i].tolist(), v[i].tolist()) for i in range(nk)]
    rows_q.append(("empty", 10_000, [1.0] * 5))
    if block_rows == 1:
        rows_k = rows_k[:12] + [r for r in rows_k if r[0] != "hot"][:8]
        rows_q = [r for r in rows_q if r[0] in ("hot", "empty")][:15] + [rows_q[-1]]
        keys = [r for r in rows_k if r[0] == "hot"]
        out = _attend(np.array([r[2] for r in rows_q[:15]]), np.array([r[2] for r in keys]), np.array([r[3] for r in keys]))
        want = {r[1]: o for r, o in zip(rows_q, out)}
    queries = spark.createDataFrame(rows_q, "g string, id int, q array<double>").repartition(6)
    keys = spark.createDataFrame(rows_k, "g string, id int, k array<double>, v array<double>").repartition(6)
    got = {r.id: r.attended for r in attention.softmax_attend(queries, keys, "g", "id", "id", block_rows=block_rows).collect()}
    assert got.pop(10_000) is None
    assert set(got) == set(want)
    for i, vector in want.items():
        assert np.allclose(got[i], vector)


@pytest.mark.parametrize("block_rows", [1000, 9])
def test_attention_of_a_table_to_itself(spark, block_rows):
    x = RNG.normal(size=(40, 4))
    rows = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "g string, id int, x array<double>")
    made = attention.softmax_attend(rows, rows, "g", "id", "id", "x", "x", "x", block_rows=block_rows)
    assert np.allclose(matrix_of(made, "id", "attended"), _attend(x, x, x))


@pytest.mark.parametrize("shape", [(4, 4, 3), (5, 6, 2)])
def test_self_attention(spark, shape):
    h, w, c = shape
    x = RNG.normal(size=(6, h, w, c))
    theta, phi, g, out = (RNG.normal(size=s) for s in ((c, 2), (c, 2), (c, 4), (4, c)))
    want = []
    for image in x:
        pool = lambda y: y[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2, -1).max(axis=(1, 3)).reshape(h // 2 * (w // 2), -1)
        seen = _attend((image @ theta).reshape(h * w, -1), pool(image @ phi), pool(image @ g))
        want.append((image + 0.7 * (seen @ out).reshape(h, w, c)).ravel())
    df = table(spark, x.reshape(6, -1), key="id")
    attended = attention.self_attention(F.col("v"), h, w, c, theta, phi, g, out, 0.7)
    assert np.allclose(matrix_of(df.withColumn("out", attended), "id", "out"), want)
    unchanged = attention.self_attention(F.col("v"), h, w, c, theta, phi, g, out, 0.0)
    assert np.array_equal(matrix_of(df.withColumn("out", unchanged), "id", "out"), x.reshape(6, -1))


def test_channel_moments_ignore_partitioning(spark):
    df = table(spark, RNG.normal(size=(40, 8)))
    one = moments.channel_moments(df.coalesce(1), "v", 2).orderBy("channel").collect()
    many = moments.channel_moments(df.repartition(9), "v", 2).orderBy("channel").collect()
    for a, b in zip(one, many):
        assert np.allclose((a["mean"], a.variance), (b["mean"], b.variance))


def test_joined_projection_refuses_what_does_not_fit(spark):
    from pyspark.errors import PySparkException

    weights = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row int, w array<double>")
    bias = spark.createDataFrame([(1, 10.0)], "pos int, b double")
    fits = spark.createDataFrame([(1, [1.0, 1.0])], "id int, v array<double>")
    assert linalg.project_by_join(fits, "id", "v", weights, "out", bias).first().out == [4.0, 16.0]
    long = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "id int, v array<double>")
    with pytest.raises(PySparkException, match="against 2 matrix rows"):
        linalg.project_by_join(long, "id", "v", weights, "out").collect()
    with pytest.raises(ValueError, match="ragged"):
        linalg.project_by_join(fits, "id", "v", spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row int, w array<double>"), "out")


def test_joined_projection_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(linalg, "TILE_ROWS", 4)
    monkeypatch.setattr(linalg, "TILE_COLUMNS", 3)
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(50, 11)), rng.normal(size=(11, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(3)
    weights = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "row int, w array<double>")
    got = {r.id: r.out for r in linalg.project_by_join(df, "id", "v", weights, "out").collect()}
    assert np.allclose([got[i] for i in range(50)], x @ w)


def test_aligned_mean_refuses_null_and_empty_vectors(spark):
    for bad in (None, []):
        df = spark.createDataFrame([("a", [1.0]), ("b", bad)], "name string, v array<double>")
        with pytest.raises(Exception, match="null vector|empty vector"):
            linalg.aligned_vector_mean(df, "name", "v").collect()


def test_plan_of_many_iterations_stays_small(spark):
    import time

    rows = spark.createDataFrame([(i, [float(i + j) for j in range(4)], 1.0) for i in range(5)], "c int, v array<double>, u double")
    made = linalg.rescale_map(rows, "v", "u", num_iters=8)
    started = time.time()
    text = made._jdf.queryExecution().toString()
    assert time.time() - started < 2 and len(text.splitlines()) < 400
    matrix = np.array([[i + j for j in range(4)] for i in range(5)], float)
    got = np.array([r.v for r in made.orderBy("c").collect()])
    assert np.allclose(got, matrix / np.linalg.svd(matrix)[1][0])
