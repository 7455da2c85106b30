import pytest
from pyspark.sql import functions as F

from samplewright.llm import mixing
from samplewright.llm.mixing import mix_sources, source_targets, word_count


def brute_targets(sizes, weights, share, most):
    """Shares the whole out again and again until nobody is above the cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, target, free = share * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        weight = sum(w[s] for s in free)
        over = [s for s in free if weight and left * w[s] / weight >= most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / weight for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 9, "ä": 3, "z": 300}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
    got = {r.source: r.target for r in source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert got == pytest.approx({s: want.get(s, 0.0) for s in sizes})


def test_taken_words(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), ["a", "b", "c", None][i % 7 % 4]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mix_sources(docs, "doc_id", "text", "source")
    per = first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 20.5 for r in per)
    again = mix_sources(docs.repartition(7), "doc_id", "text", "source")
    assert sorted((r.doc_id, r.copies) for r in first.collect()) == sorted((r.doc_id, r.copies) for r in again.collect())
    assert {r.copies for r in first.collect()} <= {0, 1, 2}


def test_quality_raises_the_chance(spark):
    rows = [(i, "w", "a") for i in range(4000)] + [(i, "w " * 20, "b") for i in range(4000, 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    good = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    mixed = mix_sources(docs, "doc_id", "text", "source", weights=(1, 9), share=0.4, quality=good)
    taken = {r.even: r.n for r in mixed.where("source = 'b'").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("copies").alias("n")).collect()}
    assert taken[True] > 1.5 * taken[False]


def test_odd_texts(odd):
    got = mix_sources(odd, "doc_id", "text", "source").collect()
    assert len(got) == 10
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (0, 1, 2))
    assert word_count(F.lit("a")) is not None


def test_empty(empty):
    assert mix_sources(empty, "doc_id", "text", "source").count() == 0


@pytest.mark.parametrize("quality", [0.1, 1.0, 3.0])
def test_buckets_stay_small_at_any_quality(spark, quality):
    key = -F.log(mixing.unit_hash(1, F.col("id"))) / quality
    rows = spark.range(400_000).select(F.lit(None).cast("string").alias("source"), key.alias("key"))
    found = mixing.with_buckets(rows).groupBy("source", "cell", "step").agg(
        F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")
    ).orderBy("cell", "step").collect()
    assert sum(r.n for r in found) == 400_000
    assert max(r.n for r in found) <= 2 * mixing.ROWS_PER_BUCKET
    assert all(a.high < b.low for a, b in zip(found, found[1:]))


def test_a_source_of_junk(spark):
    rows = [(i, "#$% " * (1 + i % 5), "junk") for i in range(5000)] + [(i, "word " * 3, "s") for i in range(5000, 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per = mix_sources(docs, "doc_id", "text", "source").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"))
    assert all(abs(r.t - r.target) <= 3 for r in per.collect())
