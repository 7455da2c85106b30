"""Slots that are filled again, and the bounded buffer."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from samplewright.functions.hashing import hash_key
from samplewright.operators import weave


def pull(shards, cycle_length):
    """The order in which a loop over slots pulls records out of lists, one at a time."""
    waiting, slots, out, at = [list(s) for s in shards], [None] * cycle_length, [], 0
    while waiting or any(s is not None for s in slots):
        if slots[at] is None and waiting:
            slots[at] = waiting.pop(0)
        if slots[at]:
            out.append(slots[at].pop(0))
        else:
            slots[at] = None
        at = (at + 1) % cycle_length
    return out


@pytest.mark.parametrize("cycle_length", [1, 2, 5, 40])
def test_positions_are_those_of_a_loop(cycle_length):
    rng = random.Random(cycle_length)
    lengths = [rng.choice([0, 1, 2, 7, 30]) for _ in range(25)]
    placed = weave.fill_slots(lengths, cycle_length)
    runs = list(weave.steady_turns(placed, lengths))
    at = {}
    for k, (slot, start) in enumerate(placed):
        for pos in range(lengths[k]):
            turn = start + pos
            (run,) = [r for r in runs if r[0] <= turn < r[1]]
            at[run[2] + (turn - run[0]) * len(run[3]) + run[3].index(slot)] = (k, pos)
    want = pull([[(k, p) for p in range(n)] for k, n in enumerate(lengths)], cycle_length)
    assert [at[i] for i in range(len(at))] == want


@pytest.mark.parametrize("cycle_length", [1, 3, 64])
def test_interleave_refill(spark, cycle_length):
    lengths = [40, 3, 1, 17, 17, 8, 25, 2]
    rows = [(f"s{k}", 100 * k + i) for k, n in enumerate(lengths) for i in range(n)]
    df = spark.createDataFrame(rows, "shard string, id long").repartition(5)
    got = weave.interleave_refill(df, "shard", "id", cycle_length, seed=1).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(rows)))
    order = [r.shard for r in df.select("shard").distinct().orderBy(hash_key(1, "shards", F.col("shard")), "shard").collect()]
    assert [r.id for r in got] == pull([[i for s, i in rows if s == name] for name in order], cycle_length)


def test_interleave_refill_of_nothing(spark):
    df = spark.createDataFrame([], "shard string, id long")
    assert weave.interleave_refill(df, "shard", "id", 3).count() == 0
    with pytest.raises(ValueError, match="cycle_length"):
        weave.interleave_refill(df, "shard", "id", 0)


def by_heap(keys, buffer):
    """What a heap of ``buffer`` records gives up as records come in one after the other."""
    heap, out = [], []
    for place, key in enumerate(keys):
        heapq.heappush(heap, (key, place))
        if len(heap) > buffer:
            out.append(heapq.heappop(heap)[1])
    return out + [heapq.heappop(heap)[1] for _ in range(len(heap))]


@pytest.mark.parametrize(("buffer", "bits"), [(1, 3), (7, 2), (100, 6), (5000, None)])
def test_buffer_is_a_heap(spark, buffer, bits):
    n, epochs = 600, 2
    df = spark.range(n).select((F.col("id") * 10).alias("id")).repartition(7)
    got = weave.shuffle_buffered(df, "id", buffer, seed=4, epochs=epochs, total="total", bits=bits).collect()
    assert sorted(r["rank"] for r in got) == list(range(n * epochs))
    assert {r.total for r in got} == {n * epochs}
    orders = []
    for epoch in range(epochs):
        out = [r.place for r in sorted(got, key=lambda r: r["rank"]) if r.epoch == epoch]
        assert sorted(out) == list(range(n))
        assert all(abs(rank - place) < buffer for rank, place in enumerate(out))
        keyed = spark.range(n).select((F.col("id") + weave.uniform_int(weave.hash_word(4, "buffer", F.lit(epoch), F.col("id")), buffer)).alias("k"))
        assert out == by_heap([r.k for r in keyed.collect()], buffer)
        orders.append(out)
    assert (orders[0] == list(range(n))) == (buffer == 1)
    assert buffer == 1 or orders[0] != orders[1]


def test_buffer_of_nothing(spark):
    assert weave.shuffle_buffered(spark.range(0), "id", 5, seed=1).count() == 0
    with pytest.raises(ValueError, match="buffer"):
        weave.shuffle_buffered(spark.range(5), "id", 0, seed=1)
