"""Interleaving shards over a number of slots that are filled again, and shuffling within a buffer."""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import whole_div
from ..functions.hashing import hash_key, hash_word, uniform_int
from ..session import store
from .feed import repeat_epochs
from .ranking import bucket_bits, bucketed_rank, ordered_rank


def fill_slots(lengths: Sequence[int], cycle_length: int) -> list[tuple[int, int]]:
    """(slot, first turn) of shards taken in this order.

    In each turn every slot gives one record, in the order of slots. A slot whose shard has ended finds that out
    on its next turn, which gives nothing, and opens the next shard on the turn after.
    """
    free = [(0, slot) for slot in range(cycle_length)]
    out = []
    for length in lengths:
        turn, slot = heapq.heappop(free)
        out.append((slot, turn))
        heapq.heappush(free, (turn + length + 1, slot))
    return out


def steady_turns(placed: Sequence[tuple[int, int]], lengths: Sequence[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """Runs of turns in which the same slots give records: (first turn, turn after the last, records before, slots)."""
    events: dict[int, tuple[list[int], list[int]]] = {}
    for (slot, turn), length in zip(placed, lengths, strict=True):
        if length:
            events.setdefault(turn, ([], []))[0].append(slot)
            events.setdefault(turn + length, ([], []))[1].append(slot)
    busy: list[int] = []
    before, last = 0, 0
    for turn in sorted(events):
        if busy:
            yield last, turn, before, list(busy)
            before += len(busy) * (turn - last)
        opened, ended = events[turn]
        for slot in ended:
            busy.remove(slot)
        for slot in opened:
            insort(busy, slot)
        last = turn


_PLAN = "place bigint, slot int, start bigint, until bigint, before bigint, slots array<int>"


def _planned(cycle_length: int):
    def plan(shards: pa.Table) -> pa.Table:
        rows = sorted(zip(shards["place"].to_pylist(), shards["length"].to_pylist(), strict=True))
        lengths = [n for _, n in rows]
        placed = fill_slots(lengths, cycle_length)
        out = [(place, slot, turn, None, None, None) for (place, _), (slot, turn) in zip(rows, placed, strict=True)]
        out += [(None, None, *run) for run in steady_turns(placed, lengths)]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = [f.split()[0] for f in _PLAN.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return plan


def interleave_refill(df: DataFrame, shard: str, record: str, cycle_length: int, seed: int = 0) -> DataFrame:
    """Round-robins records over ``cycle_length`` slots; a slot whose shard has ended takes the next one.

    Shards are taken in hash order (``fill_slots``). Adds ``slot``, ``pos`` (record within the shard), ``turn`` and
    ``seq``, the position in the interleaved order (turn, slot).

    Which shard goes to which slot when follows from the shard lengths alone: that is worked out on one row for each
    shard. Between two starts or ends of shards the same slots are busy, so a record's position is a sum;
    records find their run of turns by an equality join on cells of turns, and are never sorted by position.
    """
    if cycle_length < 1:
        raise ValueError("cycle_length must be at least 1")
    lengths = df.groupBy(shard).agg(F.count(F.lit(1)).alias("length"))
    keyed = lengths.withColumn("_key", hash_key(seed, "shards", F.col(shard).cast("string")))
    # One row for each file, so a plain window will do.
    numbered = store(keyed.select(shard, "length", (F.row_number().over(Window.orderBy("_key", shard)) - 1).cast("bigint").alias("place")), "shards")
    plan = store(numbered.select("place", "length").groupBy().applyInArrow(_planned(cycle_length), _PLAN), "turns")

    slots = numbered.join(plan.where("place IS NOT NULL").select("place", "slot", "start"), "place").select(shard, "slot", "start")
    runs = plan.where("place IS NULL").select(F.col("start").alias("_from"), F.col("until").alias("_to"), "before", "slots")
    size = runs.agg(F.max("_to"), F.count("*")).first()
    width = max(1, -(-(size[0] or 0) // max(1, size[1])))  # as many cells as there are runs
    cells = F.sequence(whole_div(F.col("_from"), width), whole_div(F.col("_to") - 1, width))
    runs = runs.withColumn("_cell", F.explode(cells))

    ranked = ordered_rank(df, record, group=[shard], rank="pos", per_group=slots).withColumn("turn", F.col("start") + F.col("pos"))
    inside = (F.col("_of") == F.col("_cell")) & (F.col("turn") >= F.col("_from")) & (F.col("turn") < F.col("_to"))
    met = ranked.withColumn("_of", whole_div(F.col("turn"), width)).join(runs, inside)
    turns = (F.col("turn") - F.col("_from")) * F.size("slots")
    seq = F.col("before") + turns + F.array_position("slots", F.col("slot")) - 1
    return met.withColumn("seq", seq.cast("bigint")).drop("start", "before", "slots", "_from", "_to", "_cell", "_of")


def shuffle_buffered(
    df: DataFrame, record: str, buffer: int, seed: int, epochs: int = 1, total: str | None = None, bits: int | None = None
) -> DataFrame:
    """Shuffle of records that pass a buffer of ``buffer`` records in the order of the numeric column ``record``.

    Adds ``epoch``, ``place`` (0-based, in the order that came in) and ``rank`` (in the order that goes out, running on
    across epochs, each of which is drawn anew). The record at place i leaves the buffer by i + d, d being drawn
    from 0 .. buffer - 1: that is a heap of ``buffer`` records which gives up its smallest key whenever one comes in. So a
    record moves by less than ``buffer`` places in either direction, and a buffer of one changes nothing.

    Keys are nearly in order already: they are cut into ranges, which are counted and ranked on their own, with no sort
    of the whole table; where a range ends, its keys and not its places decide, which hands records on to the next one.
    """
    if buffer < 1:
        raise ValueError("buffer must be at least 1")
    placed = ordered_rank(df, record, rank="place", total="_rows")
    repeated = repeat_epochs(placed, epochs)
    delay = uniform_int(hash_word(seed, "buffer", F.col("epoch"), F.col("place")), buffer)
    keyed = repeated.withColumn("_key", F.col("place") + delay)
    width = F.greatest(F.lit(1).cast("bigint"), whole_div(F.col("_rows") + buffer, 1 << (bits or bucket_bits(df))))
    keyed = keyed.withColumn("_bucket", F.call_function("div", F.col("_key"), width))
    ranked = bucketed_rank(keyed, "_bucket", ["_key", "place"], group=["epoch"], rank="_within")
    ranked = ranked.withColumn("rank", F.col("epoch") * F.col("_rows") + F.col("_within"))
    if total is not None:
        ranked = ranked.withColumn(total, F.col("_rows") * epochs)
    return ranked.drop("_key", "_rows", "_within")
