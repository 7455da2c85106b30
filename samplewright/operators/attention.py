"""Softmax attention within groups, and the self-attention block within one image."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.arrays import doubles, required
from .kernels import DOUBLES, image_kernel, matrix_to_vectors, vectors_to_matrix

# A task holds one span of queries, one of keys, and the scores of a block of each (32 MB).
BLOCK_ROWS = 2048
SPAN_ROWS = 1 << 17


def softmax_attend(
    queries: DataFrame,
    keys: DataFrame,
    group: str,
    query_id: str,
    key_id: str,
    query: str = "q",
    key: str = "k",
    value: str = "v",
    output: str = "attended",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """sum_k softmax_k(q . k) v_k over the keys of the query's group: (group, query_id, output).

    ``query_id`` and ``key_id`` are unique within a group. Scores are raw dot products. Queries and keys
    meet as spans, and no (query, key) pair ever becomes a row. Groups larger than a block are cut into
    spans on both sides; every query span meets every key span of its group in one task, which works block
    by block and gives one partial softmax sum per query; these merge exactly. A query whose group has no
    keys gets null; a null group is an error.
    """
    # New column names on both sides: queries and keys may come from the same table.
    in_group = required(F.col(group), group).alias("_g")
    q = queries.select(in_group, F.col(query_id).alias("_id"), doubles(F.col(query)).alias("_q"))
    k = keys.select(
        in_group, F.col(key_id).alias("_id"),
        doubles(F.col(key)).alias("_k"), doubles(F.col(value)).alias("_v"),
    )
    spark = queries.sparkSession
    # A pair of spans is little data but much arithmetic, so the number of tasks must not follow from the bytes.
    tasks = 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    q_spans = _spans(q, "_q_spans", block_rows, tasks)
    k_spans = _spans(k, "_k_spans", block_rows, tasks).withColumnRenamed("_g", "_kg")
    spans = q_spans.join(k_spans, F.col("_g") == F.col("_kg"), "left").select(
        "_g", "_q_spans", F.coalesce("_k_spans", F.lit(1)).alias("_k_spans")
    )
    q = q.join(spans, "_g").select(
        "_g", "_id", "_q",
        F.pmod(F.xxhash64("_id"), F.col("_q_spans")).cast("int").alias("_qb"),
        F.explode(F.sequence(F.lit(0), F.col("_k_spans") - 1)).alias("_kb"),
    )
    k = k.join(spans, "_g").select(
        F.col("_g").alias("_kg"), "_k", "_v",
        F.pmod(F.xxhash64("_id"), F.col("_k_spans")).cast("int").alias("_with_kb"),
        F.explode(F.sequence(F.lit(0), F.col("_q_spans") - 1)).alias("_with_qb"),
    )
    q = q.repartition(tasks, "_g", "_qb", "_kb")
    k = k.repartition(tasks, "_kg", "_with_qb", "_with_kb")
    group_field = T.StructField("_g", queries.schema[group].dataType)
    id_field = T.StructField("_id", queries.schema[query_id].dataType)
    partial_schema = T.StructType([
        group_field, T.StructField("_qb", T.IntegerType()), id_field,
        T.StructField("_max", T.DoubleType()), T.StructField("_sum", T.DoubleType()), T.StructField("_acc", DOUBLES),
    ])
    met = q.groupBy("_g", "_qb", "_kb").cogroup(k.groupBy("_kg", "_with_qb", "_with_kb"))
    parts = met.applyInArrow(_attender(block_rows), partial_schema)
    out_schema = T.StructType([group_field, id_field, T.StructField(output, DOUBLES)])
    merged = parts.groupBy("_g", "_qb").applyInArrow(_merger(out_schema), out_schema)
    return merged.withColumnsRenamed({"_g": group, "_id": query_id})


def _spans(rows: DataFrame, name: str, block_rows: int, tasks: int) -> DataFrame:
    """Spans per group: about the root of the tasks for large groups, so that a row is copied no more often.

    More only where a span would have too many rows to hold.
    """
    n = F.count(F.lit(1))
    shared = F.least(F.ceil(n / block_rows), F.lit(math.isqrt(tasks)))
    return rows.groupBy("_g").agg(F.greatest(shared, F.ceil(n / SPAN_ROWS), F.lit(1)).cast("int").alias(name))


def _attender(block_rows: int):
    """Unnormalised attention of one query span over one key span, shifted by each row's maximum."""

    def attend(q: pa.Table, k: pa.Table) -> pa.Table:
        n, m = q.num_rows, k.num_rows
        q_matrix = _matrix(q, "_q")
        if n and m:
            k_matrix, v_matrix = _matrix(k, "_k"), _matrix(k, "_v")
            top, total, acc = np.full(n, -np.inf), np.zeros(n), np.zeros((n, v_matrix.shape[1]))
            for i in range(0, n, block_rows):
                here = slice(i, i + block_rows)
                for j in range(0, m, block_rows):
                    scores = q_matrix[here] @ k_matrix[j:j + block_rows].T
                    peak = np.maximum(top[here], scores.max(axis=1))
                    shrink = np.exp(top[here] - peak)
                    weights = np.exp(scores - peak[:, None])
                    total[here] = total[here] * shrink + weights.sum(axis=1)
                    acc[here] = acc[here] * shrink[:, None] + weights @ v_matrix[j:j + block_rows]
                    top[here] = peak
            vectors = matrix_to_vectors(acc)
        else:
            top, total, vectors = np.full(n, -np.inf), np.zeros(n), pa.nulls(n, pa.list_(pa.float64()))
        columns = [q.column(c).combine_chunks() for c in ("_g", "_qb", "_id")]
        columns[1] = columns[1].cast(pa.int32())
        names = ["_g", "_qb", "_id", "_max", "_sum", "_acc"]
        return pa.table([*columns, pa.array(top), pa.array(total), vectors], names=names)

    return attend


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return vectors_to_matrix(table.column(name).combine_chunks())


def _merger(schema: T.StructType):
    """Merges the partial rows of one query block as they stream in; holds one row per query."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict = {}
        top = np.empty(0)
        total = np.empty(0)
        acc = np.empty((0, 0))
        seen = np.empty(0, dtype=bool)
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            fresh = list(dict.fromkeys(i for i in ids if i not in place))
            place.update({i: len(place) + at for at, i in enumerate(fresh)})
            top = np.concatenate([top, np.full(len(fresh), -np.inf)])
            total = np.concatenate([total, np.zeros(len(fresh))])
            seen = np.concatenate([seen, np.zeros(len(fresh), dtype=bool)])
            filled = batch.filter(batch.column("_acc").is_valid())
            rows = vectors_to_matrix(filled.column("_acc")) if filled.num_rows else np.empty((0, acc.shape[1]))
            width = max(acc.shape[1], rows.shape[1])
            grown = np.zeros((len(place), width))
            grown[:len(acc), :acc.shape[1]] = acc
            acc = grown
            at = np.array([place[i] for i in filled.column("_id").to_pylist()], dtype=np.int64)
            if not len(at):
                continue
            new_top, new_total = filled.column("_max").to_numpy(), filled.column("_sum").to_numpy()
            peak = top.copy()
            np.maximum.at(peak, at, new_top)
            shrink = np.exp(np.where(seen, top - peak, 0.0))
            total, acc = total * shrink, acc * shrink[:, None]
            factor = np.exp(new_top - peak[at])
            np.add.at(total, at, new_total * factor)
            np.add.at(acc, at, rows * factor[:, None])
            top = peak
            seen[at] = True
        ids = list(place)
        with np.errstate(invalid="ignore", divide="ignore"):
            vectors = matrix_to_vectors(acc / total[:, None])
        if not seen.all():
            vectors = pa.array([v if s else None for v, s in zip(vectors.to_pylist(), seen)], pa.list_(pa.float64()))
        groups = pa.array([key[0].as_py()] * len(ids), to_arrow_type(schema[0].dataType))
        yield pa.RecordBatch.from_arrays(
            [groups, pa.array(ids, to_arrow_type(schema[1].dataType)), vectors], schema.names
        )

    return merge


def self_attention(
    image: Column,
    height: int,
    width: int,
    channels: int,
    theta: np.ndarray,
    phi: np.ndarray,
    g: np.ndarray,
    out: np.ndarray,
    sigma: float,
) -> Column:
    """x + sigma * (attention over the image's own positions): the non-local block, image by image.

    Every position queries the 2x2-max-pooled positions. ``theta`` and ``phi`` are (channels, d_k),
    ``g`` (channels, d_v), ``out`` (d_v, channels) 1x1 projections without bias. All of an image is in
    its own row, so nothing is shuffled.
    """
    shape = (height, width, channels)

    @image_kernel
    def attend(flat: np.ndarray) -> np.ndarray:
        x = flat.reshape(-1, height * width, channels)
        keys = _max_pool(x @ phi, shape)
        values = _max_pool(x @ g, shape)
        scores = (x @ theta) @ keys.transpose(0, 2, 1)
        weights = np.exp(scores - scores.max(axis=2, keepdims=True))
        weights /= weights.sum(axis=2, keepdims=True)
        return x + sigma * (weights @ values @ out)

    return attend(doubles(image))


def _max_pool(x: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    n, _, depth = x.shape
    h, w = shape[0] // 2, shape[1] // 2
    grid = x.reshape(n, shape[0], shape[1], depth)[:, :h * 2, :w * 2]
    return grid.reshape(n, h, 2, w, 2, depth).max(axis=(2, 4)).reshape(n, h * w, depth)
