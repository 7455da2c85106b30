"""Hard negatives of anchors, by searches for large inner products with coordinate pruning (LEMP).

Vectors are sorted by length and cut into buckets of similar length. A bucket holds, for every coordinate, the list
of its rows in the order of that coordinate of their unit vectors. An anchor that looks for products of at least t
needs, in a bucket of vectors no longer than l, a cosine of at least c = t / (own length * l). With c above 1 the
bucket is left out. Else the angle between the anchor and a row is arccos(c) at most, and so is the difference of their
angles to any axis: that gives a feasible range of values in a coordinate's list. The ranges of the anchor's
focus coordinates, its largest ones, are intersected, and what is left is verified exactly. t rises with the best
products found so far, longest vectors first.

Anchors meet buckets in tiles: a chunk of anchors and some buckets, both bounded, are one task. Each tile gives the
best few rows of each anchor and search, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from ..shipping import ship

#: Rows in a bucket, buckets in a tile, anchors in a tile, focus coordinates of an anchor.
BUCKET_ROWS, TILE_BUCKETS, TILE_ANCHORS, FOCUS = 1024, 64, 16_384, 4
#: Stands for a null id among numbers; it comes last.
_NO_ID = np.iinfo(np.int64).max
_LOW, _HIGH = -(1 << 62), 1 << 62
#: Room for rounding in unit vectors.
_SLACK = 1e-9

_BUCKETS = "bucket bigint, longest double, dim int, ids binary, uids binary, labels binary, rows binary, lists binary"
_FOUND = "anchor bigint, slot int, id bigint, score bigint"


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, short ones filled up with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    out = np.zeros((len(sizes), dim), flat.dtype)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(sizes.sum()) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, unit vectors); a vector of zeros stays one."""
    rows = rows.astype(np.float64)
    lengths = np.sqrt((rows * rows).sum(axis=1))
    return lengths, rows / np.maximum(lengths, 1e-300)[:, None]


def _bucketed(rows_per_bucket: int):
    """Buckets of rows (id, uid, label, vec) that come in the order of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, 0

        def out(table: pa.Table) -> pa.RecordBatch:
            uids = table["uid"].combine_chunks().to_numpy()
            rows = _matrix(table["vec"].combine_chunks()).astype(np.int32)
            lengths, units = _units(rows)
            lists = np.argsort(units, axis=0, kind="stable").T.astype(np.int32)
            ids = table["id"].combine_chunks().fill_null(_NO_ID).to_numpy()
            labels = table["label"].combine_chunks().to_numpy()
            values = [int(uids[0]), float(lengths.max()), rows.shape[1], *(np.ascontiguousarray(x).tobytes() for x in (ids, uids, labels, rows, lists))]
            kinds = [pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 5]
            names = ["bucket", "longest", "dim", "ids", "uids", "labels", "rows", "lists"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= rows_per_bucket:
                table = pa.Table.from_batches(held)
                yield out(table.slice(0, rows_per_bucket))
                held, n, made = table.slice(rows_per_bucket).to_batches(), n - rows_per_bucket, made + 1
        if n:
            yield out(pa.Table.from_batches(held))

    return run


class _Bucket:
    def __init__(self, row: dict):
        self.longest, self.dim = row["longest"], row["dim"]
        self.ids, self.uids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "uids", "labels"))
        n = len(self.ids)
        self.rows = np.frombuffer(row["rows"], np.int32).reshape(n, self.dim)
        self.lists = np.frombuffer(row["lists"], np.int32).reshape(self.dim, n)
        self.units = _units(self.rows)[1]


def feasible(bucket: _Bucket, units: np.ndarray, focus: np.ndarray, least: np.ndarray) -> Iterator[np.ndarray | None]:
    """For each unit vector, the rows of a bucket that its focus coordinates let through for a cosine of ``least``.

    None stands for all rows: the narrowest range of the lists has more than half of them.
    """
    n = len(bucket.ids)
    turn = np.arccos(np.clip(least - _SLACK, -1.0, 1.0))[:, None]
    own = np.arccos(np.clip(np.take_along_axis(units, focus, axis=1), -1.0, 1.0))
    low = np.cos(np.minimum(np.pi, own + turn)) - _SLACK
    high = np.cos(np.maximum(0.0, own - turn)) + _SLACK
    start, stop = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
    for f in np.unique(focus):
        values = bucket.units[bucket.lists[f], f]
        at = focus == f
        start[at] = np.searchsorted(values, low[at], "left")
        stop[at] = np.searchsorted(values, high[at], "right")
    narrow = np.argsort(stop - start, axis=1)
    for i in range(len(units)):
        first, *rest = narrow[i]
        a, b = start[i, first], stop[i, first]
        if 2 * (b - a) > n:
            yield None
            continue
        rows = bucket.lists[focus[i, first], a:b]
        for k in rest:
            value = bucket.units[rows, focus[i, k]]
            rows = rows[(value >= low[i, k]) & (value <= high[i, k])]
        yield rows


class _Searches:
    """The searches of a tile's anchors: for each a few slots (low, high), of which the best ``k`` rows are kept."""

    def __init__(self, table: pa.Table, k: int, same_label: bool):
        self.k, self.same = k, same_label
        self.uids, self.labels = (table[c].combine_chunks().to_numpy() for c in ("uid", "label"))
        self.rows = _matrix(table["vec"].combine_chunks())
        self.lengths, self.units = _units(self.rows)
        lows, highs = (table[c].to_pylist() for c in ("lows", "highs"))
        self.counts = [len(x) for x in lows]
        shape = (len(lows), max(self.counts, default=0))
        # What a row must reach, and may reach, to get into a slot; slots that are empty or missing take none.
        self.low, self.high = np.full(shape, _HIGH, np.float64), np.full(shape, _LOW, np.float64)
        for i, (low, high) in enumerate(zip(lows, highs, strict=True)):
            for slot, (x, y) in enumerate(zip(low, high, strict=True)):
                if x <= y:
                    self.low[i, slot], self.high[i, slot] = x, y
        none = np.zeros(0, np.int64)
        self.best = [[(none, none)] * n for n in self.counts]

    @property
    def least(self) -> np.ndarray:
        """What a row must reach to get into any slot of an anchor."""
        return self.low.min(axis=1, initial=_HIGH)

    def offer_all(self, some: np.ndarray, bucket: _Bucket, scores: np.ndarray) -> None:
        """Products of some anchors with all rows of a bucket."""
        fits = np.zeros(scores.shape, bool)
        for slot in range(self.low.shape[1]):
            fits |= (scores >= self.low[some, slot, None]) & (scores <= self.high[some, slot, None])
        equal = bucket.labels[None, :] == self.labels[some, None]
        at, rows = np.nonzero(fits & (equal if self.same else ~equal))
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1) if len(at) else []:
            self._take(some[at[part[0]]], bucket, rows[part], scores[at[part[0]], rows[part]])

    def offer(self, i: int, bucket: _Bucket, rows: np.ndarray, scores: np.ndarray) -> None:
        """Products of an anchor with some rows of a bucket."""
        kept = (bucket.labels[rows] == self.labels[i]) == self.same
        kept &= scores >= self.low[i].min()
        if kept.any():
            self._take(i, bucket, rows[kept], scores[kept])

    def _take(self, i: int, bucket: _Bucket, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.same:
            other = bucket.uids[rows] != self.uids[i]
            rows, scores = rows[other], scores[other]
        ids = bucket.ids[rows]
        for slot in range(self.counts[i]):
            fits = (scores >= self.low[i, slot]) & (scores <= self.high[i, slot])
            if not fits.any():
                continue
            old_scores, old_ids = self.best[i][slot]
            s, d = np.concatenate([old_scores, scores[fits].astype(np.int64)]), np.concatenate([old_ids, ids[fits]])
            if len(s) > self.k:  # rows below the k-th product can't be among the first k
                fit = s >= np.partition(s, -self.k)[-self.k]
                s, d = s[fit], d[fit]
            order = np.lexsort([d, -s])[: self.k]
            self.best[i][slot] = s[order], d[order]
            if len(order) == self.k:
                self.low[i, slot] = s[order[-1]]

    def found(self) -> pa.Table:
        rows = [
            (uid, slot, None if d == _NO_ID else d, s)
            for uid, best in zip(self.uids.tolist(), self.best, strict=True)
            for slot, (scores, ids) in enumerate(best)
            for s, d in zip(scores.tolist(), ids.tolist(), strict=True)
        ]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW_FOUND, strict=True)], schema=_ARROW_FOUND)


_ARROW_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _search_tile(k: int, same_label: bool, focus: int):
    def run(buckets: pa.Table, anchors: pa.Table) -> pa.Table:
        if not buckets.num_rows or not anchors.num_rows:
            return _ARROW_FOUND.empty_table()
        todo = _Searches(anchors, k, same_label)
        for row in sorted(buckets.to_pylist(), key=lambda r: (-r["longest"], r["bucket"])):
            bucket = _Bucket(row)
            dim = min(bucket.dim, todo.rows.shape[1])
            reach = todo.lengths * bucket.longest
            least = todo.least
            open_ = np.flatnonzero((least <= reach * (1 + _SLACK)) & (least < _HIGH))
            if not len(open_):
                continue
            # Whole products fit a double exactly up to 2**53.
            most = dim * int(np.abs(todo.rows).max(initial=0)) * int(np.abs(bucket.rows).max(initial=0))
            if most >= 1 << 62:
                raise ValueError("inner products are too large for 64 bits")
            kind = np.float64 if most < 1 << 53 else np.int64
            values, own = bucket.rows[:, :dim].astype(kind), todo.rows[:, :dim].astype(kind)
            need = least[open_] / np.maximum(reach[open_], 1e-300)
            units = todo.units[open_, :dim]
            count = min(focus, dim)
            picks = np.argpartition(-np.abs(units), count - 1, axis=1)[:, :count] if count else np.zeros((len(open_), 0), np.int64)
            tight = need > 0 if count else np.zeros(len(open_), bool)
            whole = open_[~tight].tolist()
            for i, rows in zip(open_[tight].tolist(), feasible(bucket, units[tight], picks[tight], need[tight]), strict=True):
                if rows is None:
                    whole.append(i)
                elif len(rows):
                    todo.offer(i, bucket, rows, values[rows] @ own[i])
            for first in range(0, len(whole), 256):
                some = np.array(whole[first : first + 256])
                todo.offer_all(some, bucket, own[some] @ values.T)
        return todo.found()

    return run


def _tiled(buckets: DataFrame, n_buckets: int, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The best ``k`` rows of each anchor and slot: (anchor, slot, id, score, place); place counts from 1."""
    spark = buckets.sparkSession
    chunks = max(1, -(-anchors.count() // TILE_ANCHORS))
    # Few buckets are dealt out over all cores, many in tiles of a fixed size.
    wanted = 4 * spark.sparkContext.defaultParallelism
    tiles = max(1, min(n_buckets, max(wanted // chunks, -(-n_buckets // TILE_BUCKETS))))
    left = buckets.withColumn("tile", F.pmod(F.xxhash64("bucket"), F.lit(tiles)).cast("int"))
    left = left.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = anchors.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int"))
    right = right.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk")).applyInArrow(_search_tile(k, same_label, FOCUS), _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine(
    rows: DataFrame,
    id_col: str,
    vector_col: str,
    label_col: str,
    is_anchor: Column,
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(scale * x), and a score is the integer inner product of two rows. Higher scores come
    first, equal ones by smaller id. An anchor's positives are its first ``positives`` other rows of its label. For
    each, the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the
    positive's are returned, ranked from 1. The search is exact: every row is in a bucket, and pruning leaves out no row
    that could be returned.

    Rows with a null label, a null vector, or a null or non-finite component take no part. A vector that is shorter than
    others counts as filled up with zeros. Null ids come last among equal scores. Repeated rows are rows of their own,
    so the copy of an anchor is one of its positives. Components beyond 2**31 raise an error. ``label_col`` holds
    whole numbers. Other columns are ignored. An empty table gives no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fits = lambda x: F.abs(x) < float(1 << 31)
    whole = F.transform(vector, lambda x: F.floor(F.when(fits(x.cast("double") * scale), x.cast("double") * scale).otherwise(F.raise_error(F.lit("a component is too large")))))
    base = rows.where(F.col(label_col).isNotNull() & vector.isNotNull() & ~bad)
    base = base.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        whole.alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    base = base.withColumn("squares", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    base = store(base.withColumn("uid", F.monotonically_increasing_id()), "vectors")

    by_length = base.repartitionByRange(F.desc("squares"), "uid").sortWithinPartitions(F.desc("squares"), "uid")
    buckets = store(by_length.select("id", "uid", "label", "vec").mapInArrow(_bucketed(bucket_rows), _BUCKETS), "buckets")
    n_buckets = buckets.count()
    anchors = base.where("is_anchor").select("id", "uid", "label", "vec")

    limits = [F.array(F.lit(v).cast("long")) for v in (_LOW, _HIGH)]
    first = anchors.withColumn("lows", limits[0]).withColumn("highs", limits[1]).drop("id")
    found = store(_tiled(buckets, n_buckets, first, positives, True), "positives")

    of_score = F.sort_array(F.collect_list(F.struct("place", "score")))  # at most ``positives`` of them
    scores = found.groupBy(F.col("anchor").alias("uid")).agg(of_score.alias("p"))
    hundredth = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100)).cast("long")  # noqa: E731  rounded down
    second = anchors.join(scores, "uid").select(
        "uid",
        "label",
        "vec",
        F.transform("p", lambda p: -hundredth(p["score"] * F.lit(-low))).alias("lows"),
        F.transform("p", lambda p: hundredth(p["score"] * F.lit(high))).alias("highs"),
    )
    hard = _tiled(buckets, n_buckets, store(second, "anchors"), negatives, False)
    hard = hard.select("anchor", (F.col("slot") + 1).alias("slot"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("anchor", F.col("place").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = named.join(hard, ["anchor", "slot"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
