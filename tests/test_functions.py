"""Expressions against hand values and NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.functions import arrays as A
from samplewright.functions import hashing as H
from samplewright.functions import images as I
from samplewright.operators import raster as R

VECTORS = [[3.0, 4.0], [0.0, 0.0], [-1.5, 2.5], [1e-3, -700.0]]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(list(enumerate(VECTORS)), "id int, v array<double>")


def column(df, expr, order="id"):
    return [r[0] for r in df.orderBy(order).select(expr.alias("out")).collect()]


def test_l2_normalize_keeps_zero_and_puts_eps_outside_the_root(vectors):
    got = column(vectors, A.l2_normalize(F.col("v"), eps=1.0))
    want = [np.array(v) / (np.sqrt(np.sum(np.square(v))) + 1.0) for v in VECTORS]
    assert np.allclose(got, want)
    assert column(vectors, A.l2_normalize(F.col("v")))[1] == [0.0, 0.0]


def test_softmax_rows_sum_to_one_and_do_not_overflow(vectors):
    rows = np.array(column(vectors, A.softmax(F.transform("v", lambda x: x * 10))))
    assert np.allclose(rows.sum(axis=1), 1.0)
    assert np.isfinite(rows).all()


def test_activations(spark):
    xs = [-800.0, -2.0, 0.0, 0.5, 800.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    x = np.array(xs)
    assert np.allclose(column(df, A.softplus(F.col("x"))), np.logaddexp(0, x))
    assert np.allclose(column(df, A.lrelu(F.col("x"))), np.where(x > 0, x, 0.2 * x))
    assert np.allclose(column(df, A.relu(F.col("x"))), np.maximum(x, 0))


def test_bytes_scaling_and_truncation(spark):
    data = bytes(range(256))
    df = spark.createDataFrame([(1, data)], "id int, b binary")
    ints = A.bytes_to_ints(F.col("b"))
    assert column(df, ints)[0] == list(range(256))
    assert bytes(column(df, A.ints_to_bytes(ints))[0]) == data
    scaled = np.array(column(df, A.scale_pixels(ints))[0])
    assert scaled[0] == -1.0 and scaled[255] == 1.0
    cut = column(df, A.to_uint8(A.scale_pixels(ints)))[0]
    assert cut == np.floor((scaled + 1.0) * 127.5).astype(int).tolist()
    assert cut != list(range(256)), "truncation loses some values"
    assert column(df, A.to_uint8(A.scale_pixels(ints), rounding="nearest"))[0] == list(range(256))
    assert column(spark.createDataFrame([(1, b"")], "id int, b binary"), A.bytes_to_ints(F.col("b"))) == [[]]


def test_one_hot_off_the_range_is_all_zeros(spark):
    df = spark.createDataFrame([(0, 2), (1, 5), (2, -1)], "id int, c int")
    assert column(df, A.one_hot(F.col("c"), 3)) == [[0, 0, 1], [0, 0, 0], [0, 0, 0]]


def test_label_range_check(spark):
    df = spark.createDataFrame([(0, 1), (1, 1000)], "id int, label bigint")
    assert column(df, A.label_with_offset(F.col("label"), -1)) == [0, 999]
    assert column(df, A.label_with_offset(F.col("label"), -1, 1000)) == [0, 999]
    with pytest.raises(PySparkException, match="label off"):
        column(df, A.label_with_offset(F.col("label"), 0, 1000))


def test_normal_vectors_are_normal_and_reproducible(spark):
    df = spark.range(2000).select("id", H.normal_vector(5, F.col("id"), 7).alias("z"))
    first = {r.id: r.z for r in df.collect()}
    again = {r.id: r.z for r in df.repartition(13).collect()}
    assert first == again
    z = np.array(list(first.values()))
    assert z.shape == (2000, 7)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert np.abs(np.corrcoef(z.T) - np.eye(7)).max() < 0.1


def test_uniform_int_covers_the_range(spark):
    df = spark.range(20000).select(H.uniform_int(H.hash_word(1, F.col("id")), 10).alias("c")).groupBy("c").count()
    counts = {r.c: r["count"] for r in df.collect()}
    assert sorted(counts) == list(range(10))
    assert max(counts.values()) < 1.15 * min(counts.values())
    with pytest.raises(ValueError):
        H.uniform_int(F.lit(1), 0)


def _pool(image, merge):
    h, w, c = image.shape
    return merge(image[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2, c), axis=(1, 3))


@pytest.mark.parametrize("shape", [(4, 4, 1), (5, 7, 2), (2, 3, 3)])
def test_pools_and_upsampling(spark, shape):
    image = np.random.default_rng(0).normal(size=shape)
    df = spark.createDataFrame([(0, image.ravel().tolist())], "id int, v array<double>")
    assert np.allclose(column(df, R.avg_pool_2x2(F.col("v"), *shape))[0], _pool(image, np.mean).ravel())
    assert np.allclose(column(df, R.max_pool_2x2(F.col("v"), *shape))[0], _pool(image, np.max).ravel())
    for n in (1, 2, 3):
        want = image.repeat(n, axis=0).repeat(n, axis=1)
        assert np.allclose(column(df, R.upsample_nearest(F.col("v"), *shape, factor=n))[0], want.ravel())
    assert np.allclose(column(df, R.spatial_sum(F.col("v"), shape[2]))[0], image.sum(axis=(0, 1)))
    positive = np.maximum(image, 0).sum(axis=(0, 1))
    assert np.allclose(column(df, R.spatial_sum(F.col("v"), shape[2], positive=True))[0], positive)


def test_explode_and_collect_pixels_are_inverse(spark):
    image = list(range(3 * 5 * 2))
    df = spark.createDataFrame([(7, [float(v) for v in image])], "id int, v array<double>")
    pixels = I.explode_pixels(df, "v", width=5, channels=2)
    row = pixels.filter("y = 2 and x = 3 and c = 1").first()
    assert row.v == (2 * 5 + 3) * 2 + 1
    assert I.collect_pixels(pixels.repartition(5), ["id"], 5, 2).first().image == image


def test_squarest_grid(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([64, 12, 7, 1, 16, 36])], "id int, n bigint")
    got = [tuple(g) for g in column(df, I.squarest_grid(F.col("n")))]
    assert got == [(8, 8), (4, 3), (7, 1), (1, 1), (4, 4), (6, 6)]


def test_expressions_can_feed_a_python_function(spark):
    # Spark inlines them into the function's arguments.
    same = F.arrow_udf(lambda x: x, "array<double>")
    v = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: (b + F.col("id")).cast("double"))
    for expr in (
        A.l2_normalize(v), A.softmax(v), A.log_softmax(v), A.scale_pixels(v), A.to_unit_range(v), A.add_scaled(v, v, 2.0),
        H.normal_vector(1, F.col("id"), 6),
    ):
        df = spark.range(5).select("id", expr.alias("direct"), same(expr).alias("through"))
        assert all(r.direct == r.through for r in df.collect())


def test_vectors_of_different_lengths_are_refused(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0])], "a array<double>, b array<double>")
    for made in (A.dot(F.col("a"), F.col("b")), A.add_scaled(F.col("a"), F.col("b"))):
        with pytest.raises(PySparkException, match="different lengths"):
            df.select(made).collect()


def test_pixels_outside_the_range(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([([1.01, -1.2, 0.0],)], "v array<double>")
    assert df.select(A.to_uint8(F.col("v"), saturate=True)).first()[0] == [255, 0, 127]
    with pytest.raises(PySparkException, match="value off"):
        df.select(A.to_uint8(F.col("v"))).collect()
    with pytest.raises(PySparkException, match="not a byte"):
        spark.range(1).select(A.ints_to_bytes(F.array(F.lit(256)))).collect()
