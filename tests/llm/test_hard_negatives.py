import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samplewright.llm import hard_negatives
from samplewright.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score double, slot int"


def by_hand(rows, positives=5, negatives=3):
    """The result for rows (vec_id, embedding, label), anchors being ids divisible by 5."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], label)
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    last = lambda pair: (-pair[1], pair[0] is None, pair[0] or 0)
    out = []
    for n, (anchor, a, label) in enumerate(kept):
        if anchor is None or anchor % 5:
            continue
        scored = [(i, sum(x * y for x, y in zip(a, v)), other == label) for m, (i, v, other) in enumerate(kept) if m != n]
        for p, ps in sorted(((i, s) for i, s, same in scored if same), key=last)[:positives]:
            fit = sorted(((i, s) for i, s, same in scored if not same and 50 * ps <= 100 * s <= 95 * ps), key=last)
            out += [(anchor, p, rank, i, ps, s) for rank, (i, s) in enumerate(fit[:negatives], 1)]
    return sorted(out, key=repr)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 7, 1.0, 2) for r in rows], SCHEMA)
    made = mine(frame, "vec_id", "embedding", "label", F.col("vec_id") % 5 == 0, **more)
    return sorted((tuple(r) for r in made.collect()), key=repr)


def vectors(rng, n, dim, spread):
    centers = rng.normal(size=(6, dim))
    rows = centers[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    return (rows * rng.choice([0.05, 0.3, 1.0], (n, 1))).tolist()


@pytest.mark.parametrize(("dim", "spread", "bucket_rows"), [(2, 0.1, 16), (12, 0.2, 32), (12, 2.0, 1024)])
def test_against_all_products(spark, dim, spread, bucket_rows):
    rng = np.random.default_rng(dim)
    labels = rng.integers(0, 3, 300).tolist()
    rows = [(i, v, label) for i, (v, label) in enumerate(zip(vectors(rng, 300, dim, spread), labels))]
    got = found(spark, rows, bucket_rows=bucket_rows)
    assert got == by_hand(rows)
    assert got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(7)
    some = [(10 + i, v, i % 2) for i, v in enumerate(vectors(rng, 40, 3, 0.3))]
    copies = [(60, [1.0, 0.5, 0.0], 0)] * 2 + [(100 + i, [1.0, 0.5, 0.0], 1) for i in range(30)] + [(100 + i, [0.9, 0.5, 0.0], 0) for i in range(30)]
    odd = [
        (0, None, 1), (5, [1.0, None, 2.0], 1), (15, [1.0, nan, 0.0], 0), (20, [inf, 0.0, 0.0], 0), (25, [1.0, 1.0, 1.0], None),
        (None, [0.8, 0.4, 0.0], 0), (None, [1.0, 0.6, 0.0], 1), (200, [0.0, 0.0, 0.0], 1), (205, [], 0), (210, [1.0], 1), (215, [-1.0, -1.0, -1.0], 5),
    ]
    rows = some + copies + odd
    assert found(spark, rows, bucket_rows=8) == by_hand(rows)


def test_no_rows_and_no_anchor(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert found(spark, [(5, [1.0], 0)]) == []


def test_components_that_are_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        found(spark, [(5, [1e30], 0), (6, [1.0], 0)])


def test_pruning_leaves_out_rows_but_none_that_count():
    rng = np.random.default_rng(2)
    rows = rng.integers(-40, 40, (500, 6)) + 60 * np.eye(6, dtype=int)[rng.integers(0, 6, 500)]
    lengths = np.sqrt((rows * rows).sum(axis=1))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(500)), pa.array(range(500)), pa.array([0] * 500), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["id", "uid", "label", "vec"]
    )
    (made,) = hard_negatives._bucketed(1000)(iter([batch]))
    bucket = hard_negatives._Bucket(made.to_pylist()[0])
    units = rows[:50] / lengths[:50, None]
    least = np.linspace(0.3, 0.99, 50)
    focus = np.argpartition(-np.abs(units), 2, axis=1)[:, :3]
    sizes = []
    for i, kept in enumerate(hard_negatives.feasible(bucket, units, focus, least)):
        if kept is not None:
            want = np.flatnonzero(units[i] @ (rows / lengths[:, None]).T >= least[i])
            assert set(want) <= set(kept.tolist())
            sizes.append(len(kept))
    assert len(sizes) > 20 and max(sizes) < 250
