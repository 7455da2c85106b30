"""Image kernels, contact sheets and model scoring."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.operators import checks, raster, scoring
from samplewright.plans import jobs

RNG = np.random.default_rng(1)


def table(spark, images):
    return spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(images)], "id int, v array<double>").repartition(4)


def result(df, expr):
    return np.array([r.out for r in df.select("id", expr.alias("out")).orderBy("id").collect()])


def _bilinear(image, oh, ow):
    h, w, _ = image.shape
    out = np.empty((oh, ow, image.shape[2]))
    for y in range(oh):
        for x in range(ow):
            sy, sx = y * h / oh, x * w / ow
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, h - 1), min(x0 + 1, w - 1)
            fy, fx = sy - y0, sx - x0
            top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
            out[y, x] = top * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return out


@pytest.mark.parametrize("out", [(12, 12), (3, 9), (8, 6)])
def test_resize(spark, out):
    images = RNG.normal(size=(5, 8, 6, 3))
    got = result(table(spark, images), raster.resize_bilinear(F.col("v"), 8, 6, 3, *out))
    assert np.allclose(got, [_bilinear(x, *out).ravel() for x in images])


def _focal(image, kernel, stride, bias):
    h, w, _ = image.shape
    kh, kw, _, co = kernel.shape
    oh, ow = -(-h // stride), -(-w // stride)
    top = max((oh - 1) * stride + kh - h, 0) // 2
    left = max((ow - 1) * stride + kw - w, 0) // 2
    out = np.tile(bias, (oh, ow, 1)).astype(float)
    for y in range(oh):
        for x in range(ow):
            for dy in range(kh):
                for dx in range(kw):
                    sy, sx = y * stride + dy - top, x * stride + dx - left
                    if 0 <= sy < h and 0 <= sx < w:
                        out[y, x] += image[sy, sx] @ kernel[dy, dx]
    return out


@pytest.mark.parametrize("kernel, stride", [((3, 3), 1), ((3, 3), 2), ((5, 4), 2), ((1, 1), 1), ((1, 1), 2), ((2, 2), 3)])
def test_focal_sum(spark, kernel, stride):
    images = RNG.normal(size=(3, 7, 6, 2))
    weights, bias = RNG.normal(size=(*kernel, 2, 3)), RNG.normal(size=3)
    got = result(table(spark, images), raster.focal_sum(F.col("v"), 7, 6, weights, stride, bias))
    assert np.allclose(got, [_focal(x, weights, stride, bias).ravel() for x in images])


def test_wrong_image_size_is_an_error(spark):
    with pytest.raises(PySparkException, match="reshape"):
        result(table(spark, RNG.normal(size=(2, 5, 5, 1))), raster.resize_bilinear(F.col("v"), 4, 4, 1, 2, 2))


@pytest.mark.parametrize("order", ["row", "column"])
def test_montage_of_a_sheet_that_is_not_square(spark, order):
    images = RNG.uniform(-1, 1, size=(5, 2, 3, 1))
    tiles = table(spark, images).select(F.lit(0).alias("sheet"), F.col("id").alias("tile"), "v")
    want = np.zeros((4, 9, 1), dtype=np.uint8)
    for k, image in enumerate(images):
        r, c = (k // 3, k % 3) if order == "row" else (k % 2, k // 2)
        want[r * 2:r * 2 + 2, c * 3:c * 3 + 3] = np.floor((image + 1) * 127.5).astype(np.uint8)
    sheet = raster.montage_sheets(tiles, "v", "tile", ["sheet"], 2, 3, 1, 2, 3, order).first()
    assert (sheet.height, sheet.width) == (4, 9)
    assert bytes(sheet.canvas) == want.tobytes()
    pixels = raster.montage_pixels(tiles, "v", "tile", 2, 3, 1, 2, 3, order).collect()
    assert len(pixels) == 5 * 6
    assert all(int(np.floor((p.v + 1) * 127.5)) == want[p.y, p.x, p.c] for p in pixels)


def _models():
    """Model factories local to a function, which is how Spark ships them by value."""

    def make_classifier():
        return lambda images: {"pool": images[:, :3] * 2, "logits": images[:, :4]}

    def make_generator():
        return lambda z, class_id: {"image": z + class_id[:, None]}

    return make_classifier, make_generator


make_classifier, make_generator = _models()


def test_scoring_keeps_rows_and_order_of_values(spark):
    x = RNG.normal(size=(250, 6))
    scored = scoring.score(table(spark, x), make_classifier, {"v": 6}, ["pool", "logits"], batch_size=32)
    assert scored.columns == ["id", "v", "pool", "logits"]
    assert np.allclose([r.pool for r in scored.orderBy("id").collect()], x[:, :3] * 2)
    assert scored.filter(F.size("logits") == 4).count() == 250


def test_generated_samples_do_not_depend_on_partitions(spark):
    def samples(df):
        made = scoring.generate_samples(df, "id", make_generator, 6, 5, ["image"], seed=4)
        return {r.id: (r.class_id, r.image) for r in made.collect()}

    assert samples(spark.range(60).repartition(1)) == samples(spark.range(60).repartition(7))


@pytest.mark.parametrize("classifier_size", [None, 3])
def test_evaluation_job_matches_numpy(spark, classifier_size):
    x = RNG.normal(size=(200, 2, 3, 1))
    real = table(spark, x)
    made = scoring.generate_samples(real, "id", make_generator, 6, 5, ["image"]).collect()
    y = np.array([r.image for r in made]).reshape(-1, 2, 3, 1)
    job = jobs.evaluate(real, "id", "v", (2, 3, 1), make_classifier, make_generator, 6, 5, classifier_size)
    got = {r.name: r.value for r in job.collect()}
    if classifier_size:
        x, y = (np.array([_bilinear(i, 3, 3) for i in images]) for images in (x, y))
    x, y = x.reshape(200, -1), y.reshape(200, -1)
    a, b = x[:, :3] * 2, y[:, :3] * 2
    roots = np.sqrt(np.clip(np.linalg.eigvals(np.cov(a.T) @ np.cov(b.T)).real, 0, None)).sum()
    gap = a.mean(axis=0) - b.mean(axis=0)
    assert np.isclose(got["fid"], gap @ gap + np.trace(np.cov(a.T)) + np.trace(np.cov(b.T)) - 2 * roots)
    p = np.exp(y[:, :4])
    p /= p.sum(axis=1, keepdims=True)
    assert np.isclose(got["incscore"], np.exp(np.mean(np.sum(p * (np.log(p) - np.log(p.mean(axis=0))), axis=1))))


def test_sample_draw_is_exact(spark):
    drawn = jobs.draw_sample(spark.range(105), "id", 10, 10, seed=2)
    assert drawn.count() == 100 and drawn.select("id").distinct().count() == 100
    with pytest.raises(ValueError, match="only 105 rows"):
        jobs.draw_sample(spark.range(105), "id", 10, 11)


@pytest.mark.parametrize("n, grid", [(64, (8, 8)), (12, (4, 3)), (7, (7, 1)), (1, (1, 1))])
def test_grid_size(n, grid):
    assert jobs.grid_size(n) == grid


def test_shape_report_and_requirement(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0]), (1, [float("nan"), 1.0]), (1, None)], "k int, v array<double>"
    )
    report = {r.k: r for r in checks.shape_report(df, "v", 2, rows=2, keys=["k"]).collect()}
    assert report[0].ok and report[0].rows == 2 and report[0].incomplete == 0
    assert not report[1].ok and report[1].incomplete == 2 and report[1].shortest == -1
    assert checks.require_shape(df.filter("k = 0"), "v", 2).count() == 2
    with pytest.raises(PySparkException, match="expected length 2"):
        checks.require_shape(df, "v", 2).collect()


def test_prefix_split(spark):
    df = spark.createDataFrame([("model/d_a",), ("model/g_sigma_ratio",), ("other",), ("model/d_g",)], "name string")
    split = checks.prefix_split(df, "name", {"d": "model/d_", "g": "model/g_"}, tag="sigma_ratio")
    got = {r.name: (r.part, r.matches, r.tagged) for r in split.collect()}
    assert got["model/d_a"] == ("d", 1, False)
    assert got["model/g_sigma_ratio"] == ("g", 1, True)
    assert [r.name for r in checks.split_violations(split).collect()] == ["other"]
    both = checks.prefix_split(df, "name", {"a": "model/", "d": "model/d_"})
    assert {r.name for r in checks.split_violations(both).collect()} == {"model/d_a", "model/d_g", "other"}
