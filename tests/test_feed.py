"""Ranking, shuffling, batching and sample tables."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.operators import feed, generate
from samplewright.operators.ranking import ordered_rank
from samplewright.plans import jobs


def records(spark, n, parts=7):
    return spark.range(n).repartition(parts)


def test_ordered_rank_with_a_hot_group(spark):
    # A third of all rows in one group.
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")))
    got = ordered_rank(df, "id", group=["g"], total="n", buckets=16).collect()
    seen = {}
    for row in sorted(got, key=lambda r: r.id):
        assert row["rank"] == seen.get(row.g, 0)
        seen[row.g] = row["rank"] + 1
    assert len(got) == 3000
    assert all(row.n == seen[row.g] for row in got)


def test_ordered_rank_refuses_a_null_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id bigint, g string")
    with pytest.raises(PySparkException, match="g must not be null"):
        ordered_rank(df, "id", group=["g"]).collect()


def test_ordered_rank_of_clustered_values(spark):
    df = spark.range(500).withColumn("at", F.when(F.col("id") < 490, F.col("id")).otherwise(F.col("id") * 10**9))
    got = {r["at"]: r["rank"] for r in ordered_rank(df, "at", buckets=8).collect()}
    assert [got[a] for a in sorted(got)] == list(range(500))


def test_each_epoch_is_a_new_permutation(spark):
    got = feed.shuffle_records(records(spark, 1000), "id", seed=3, epochs=3).collect()
    by_epoch = {}
    for row in sorted(got, key=lambda r: r["rank"]):
        by_epoch.setdefault(row.epoch, []).append(row.id)
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(3000))
    assert all(sorted(ids) == list(range(1000)) for ids in by_epoch.values())
    assert len({tuple(ids) for ids in by_epoch.values()}) == 3
    assert by_epoch[0] != sorted(by_epoch[0])


def test_shuffle_does_not_depend_on_partitioning_or_buckets(spark):
    def order(df, bits):
        return {r.id: r["rank"] for r in feed.shuffle_records(df, "id", seed=3, bits=bits).collect()}

    assert order(records(spark, 500, 1), 16) == order(records(spark, 500, 11), 4)


def test_empty_and_missing_ids(spark):
    assert feed.shuffle_records(spark.range(0), "id", seed=1).count() == 0
    assert ordered_rank(spark.range(0), "id").count() == 0
    df = spark.createDataFrame([(3,), (None,), (1,)], "id bigint")
    assert sorted(r["rank"] for r in feed.shuffle_records(df, "id", seed=1).collect()) == [0, 1, 2]
    assert sorted(r["rank"] for r in ordered_rank(df, "id").collect()) == [0, 1, 2]


def test_rows_move_once(spark):
    """One exchange carries the rows; the other three carry bucket counts."""
    wide = spark.range(100).withColumn("payload", F.lit("x"))
    plan = feed.shuffle_records(wide, "id", seed=1, epochs=2)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"- (?:Broadcast)?Exchange", plan)) == 4
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches_cross_epochs_and_drop_the_remainder(spark):
    shuffled = feed.shuffle_records(records(spark, 10), "id", seed=1, epochs=2, total="n")
    got = feed.assign_batches(shuffled, 6, drop_remainder=True, total="n").collect()
    assert sorted((r.batch_id, r.position) for r in got) == [(b, p) for b in range(3) for p in range(6)]
    assert {r.epoch for r in got if r.batch_id == 1} == {0, 1}
    assert feed.assign_batches(shuffled, 6).count() == 20
    with pytest.raises(ValueError):
        feed.assign_batches(shuffled, 6, drop_remainder=True)


def test_too_few_rows_for_the_batches(spark):
    ranked = feed.shuffle_records(records(spark, 99), "id", seed=1)
    with pytest.raises(ValueError, match="only 99 rows"):
        feed.take_batches(ranked, 10, 10, 99)
    assert feed.take_batches(ranked, 10, 9, 99).count() == 90


def test_interleave_with_unequal_and_hot_shards(spark):
    rows = [(f"s{s}", s * 1000 + i) for s, n in enumerate([30, 1, 5, 0, 7, 2]) for i in range(n)]
    df = spark.createDataFrame(rows, "shard string, id bigint").repartition(5)
    got = feed.interleave_shards(df, "shard", "id", cycle_length=3).collect()
    in_order = sorted(got, key=lambda r: (r.cycle, r.pos, r.slot))
    assert [r.seq for r in in_order] == list(range(len(rows)))
    assert sorted((r.shard, r.id) for r in got) == sorted(rows)
    assert max(r.slot for r in got) == 2


def test_rank_export_names(spark):
    df = spark.range(2100).withColumn("score", -F.col("id").cast("double")).withColumn("rank", F.col("id"))
    batched = feed.assign_batches(df, 100)
    got = {r.counter: r for r in feed.rank_by_score(batched, "score", "id", 100).collect()}
    assert got[0].name == "a0.png" and got[0].id == 99 and got[0].place == 0
    assert got[27].name == "h27.png"
    assert got[999].name == "j999.png" and got[1000].name == "fake0.png"
    stopped = feed.rank_by_score(batched, "score", "id", 100, stop_at=1005)
    assert stopped.count() == 1100, "the batch that passes the limit is kept whole"


def test_accumulate_needs_something():
    with pytest.raises(ValueError):
        feed.accumulate([])


def test_weighted_class_follows_the_weights(spark):
    weights = spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 6.0), (3, 3.0)], "class_id int, weight double")
    got = generate.with_weighted_class(spark.range(20000), "id", weights, seed=2, cells=8)
    counts = {r.class_id: r["count"] for r in got.groupBy("class_id").count().collect()}
    assert sum(counts.values()) == 20000
    assert set(counts) == {0, 2, 3}
    assert abs(counts[2] / 20000 - 0.6) < 0.02 and abs(counts[0] / 20000 - 0.1) < 0.02


def test_latent_traversal(spark):
    got = generate.latent_traversal(spark.range(4), "id", z_dim=6, dims=3).collect()
    assert len(got) == 12
    for row in got:
        want = [0.0] * 6
        want[row.dim] = row.step / 4
        assert row.z == want


def test_feed_is_written_in_step_order(spark, tmp_path):
    made = jobs.training_feed(records(spark, 100), "id", epochs=2, batch_size=5, num_towers=2, z_dim=3, num_classes=4)
    path = str(tmp_path / "feed")
    jobs.write_feed(made, path, steps_per_folder=8, files=3)
    back = spark.read.parquet(path)
    assert back.count() == 200
    assert sorted(r[0] for r in back.select("step_range").distinct().collect()) == [0, 1, 2]
    sizes = back.groupBy("step_id", "tower_id").count().collect()
    assert len(sizes) == 40 and all(r["count"] == 5 for r in sizes)
    assert back.filter("fake_label between 0 and 3 and size(z) = 3").count() == 200


def test_weighted_class_keeps_rows_or_fails(spark):
    from pyspark.errors import PySparkException

    ids = spark.range(10)
    with pytest.raises(PySparkException, match="no class"):
        generate.with_weighted_class(ids, "id", spark.createDataFrame([], "class_id int, weight double"), seed=1).collect()
    with pytest.raises(PySparkException, match="below 0"):
        generate.with_weighted_class(ids, "id", spark.createDataFrame([(1, -1.0), (2, 3.0)], "class_id int, weight double"), seed=1).collect()
    with pytest.raises(PySparkException, match="must not be null"):
        nulls = spark.createDataFrame([(None,)], "id long")
        generate.with_weighted_class(nulls, "id", spark.createDataFrame([(1, 1.0)], "class_id int, weight double"), seed=1).collect()
