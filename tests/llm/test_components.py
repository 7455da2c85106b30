import random

import samplewright.llm.components as module
from samplewright.llm.components import components
from samplewright.session import store


def test_against_union_find(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(70)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((x, top(x)) for x in root)


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_few_links_make_few_files(spark, monkeypatch):
    """Whatever the number of shuffle partitions, a round of few links is one file."""
    files = []

    def stored(df, name):
        out = store(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "store", stored)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.root for r in got} == {0} and len(got) == 61
    assert len(files) > 2 and set(files[1:]) == {1}
