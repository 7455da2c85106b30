"""Singular values against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from samplewright.operators import spectrum

RNG = np.random.default_rng(9)


def table(spark, w, parts=5):
    return spark.createDataFrame([(r.tolist(),) for r in w], "v array<double>").repartition(parts)


@pytest.mark.parametrize("shape", [(400, 24), (7, 24), (1, 3), (50, 1)])
def test_tree_of_decompositions(spark, shape):
    w = RNG.normal(size=shape)
    got = spectrum.singular_values(table(spark, w), "v").orderBy("place").collect()
    want = np.linalg.svd(w, compute_uv=False)
    assert np.allclose([r.value for r in got], want, rtol=1e-10)
    assert len(spectrum.singular_values(table(spark, w), "v", k=2).collect()) == min(2, *shape)


def test_tiny_values_keep_their_digits(spark):
    """A Gram matrix would lose everything below the square root of the precision."""
    u, v = (np.linalg.qr(RNG.normal(size=s))[0] for s in ((200, 6), (6, 6)))
    want = np.array([1e6, 1e3, 1.0, 1e-3, 1e-5, 1e-6])
    got = spectrum.singular_values(table(spark, (u * want) @ v), "v").orderBy("place").collect()
    assert np.allclose([r.value for r in got], want, rtol=1e-4)


@pytest.mark.parametrize("decay", [1.0, 0.97])
def test_lanczos_on_nearly_equal_and_on_falling_values(spark, decay):
    w = RNG.normal(size=(600, 120)) * decay ** np.arange(120)
    df = table(spark, w).cache()
    got, used = spectrum.lanczos(df, "v", 120, 5)
    assert used <= 30
    assert np.allclose(got, np.linalg.svd(w, compute_uv=False)[:5], rtol=1e-8)
    wide = spectrum.singular_values(df, "v", k=5, qr_dims=100).orderBy("place").collect()
    assert np.allclose([r.value for r in wide], got, rtol=1e-12)


def test_lanczos_of_low_rank(spark):
    w = RNG.normal(size=(80, 2)) @ RNG.normal(size=(2, 50))
    got, used = spectrum.lanczos(table(spark, w), "v", 50, 4, block=4)
    assert np.allclose(got, np.linalg.svd(w, compute_uv=False)[:4], atol=1e-6) and used <= 3


def test_odd_matrices(spark):
    assert spectrum.singular_values(spark.createDataFrame([], "v array<double>"), "v").count() == 0
    assert [r.value for r in spectrum.singular_values(table(spark, np.zeros((3, 2))), "v").collect()] == [0.0, 0.0]
    with pytest.raises(PySparkException, match="vector"):
        spectrum.singular_values(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), "v").collect()
    with pytest.raises(ValueError, match="name the number"):
        spectrum.singular_values(table(spark, np.ones((2, 5))), "v", qr_dims=4)
    with pytest.raises(ValueError, match="not enough"):
        spectrum.lanczos(table(spark, RNG.normal(size=(300, 100))), "v", 100, 2, block=2, passes=2)
