"""Removal of lines that many documents share, with two Bloom filters ahead of the exact check."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from ..shipping import ship
from .arrow import pieces
from .text import SPACES

#: The filters travel in this many pieces.
_SEGMENTS = 64


def line_key(line: str, min_chars: int) -> bytes | None:
    """Hash of a line's key (stripped of ASCII white space, A-Z lower-cased); None for short keys."""
    key = line.strip(SPACES)
    if len(key) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())


def _keys(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct key hashes of a text."""
    found = {line_key(line, min_chars) for line in (text or "").split("\n")}
    found.discard(None)
    return sorted(found)


def _cells(keys: list[bytes], cells: int) -> np.ndarray:
    """Two cells for each key, one in a column."""
    return (np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) % np.uint64(cells)).astype(np.int64)


def _set(bits: np.ndarray, cells: np.ndarray) -> None:
    """Sets bits of a packed array; cells are sorted and distinct."""
    byte, first = np.unique(cells >> 3, return_index=True)
    bits[byte] |= np.bitwise_or.reduceat((128 >> (cells & 7)).astype(np.uint8), first)


def _is_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)) & 1).astype(bool)


def _fill(cells: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
        for batch in batches:
            for piece in pieces(batch, 0):
                keys = [k for text in piece.column(0).to_pylist() for k in _keys(text, min_chars)]
                if not keys:
                    continue
                for column in _cells(keys, cells).T:
                    at, n = np.unique(column, return_counts=True)
                    again = at[_is_set(once, at) | (n > 1)]
                    if len(again):
                        _set(twice, again)
                    _set(once, at)
        if once.any():
            parts = zip(np.split(once, _SEGMENTS), np.split(twice, _SEGMENTS), strict=True)
            yield _segments([(i, _pack(a), _pack(b)) for i, (a, b) in enumerate(parts) if a.any()])

    return run


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(bits.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _segments(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
        ["segment", "once", "twice"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the filters of all tasks: a cell is seen twice if it is in one of them, or once in two."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = _unpack(once), _unpack(twice)
            if segment in sums:
                a0, b0 = sums[segment]
                a, b = a | a0, b | b0 | (a & a0)
            sums[segment] = (a, b)
    if sums:
        yield _segments([(k, _pack(a), _pack(b)) for k, (a, b) in sums.items()])


def seen_twice(docs: DataFrame, text_col: str, min_chars: int, cells: int) -> np.ndarray:
    """Packed filter of the cells that keys of two documents have hit; ``cells`` / 8 bytes at any input size."""
    if cells % (8 * _SEGMENTS):
        raise ValueError(f"cells must be a multiple of {8 * _SEGMENTS}")
    filled = docs.select(text_col).mapInArrow(_fill(cells, min_chars), "segment int, once binary, twice binary")
    merged = filled.repartition(_SEGMENTS, "segment").mapInArrow(_merge, filled.schema)
    whole = np.zeros((_SEGMENTS, cells // 8 // _SEGMENTS), np.uint8)
    for row in merged.select("segment", "twice").collect():  # at most _SEGMENTS rows
        whole[row.segment] = _unpack(row.twice)
    return whole.reshape(-1)


def _suspect(twice, cells: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = twice.value
        for batch in batches:
            for piece in pieces(batch, 1):
                out: list[list[bytes]] = []
                for text in piece.column(1).to_pylist():
                    keys = _keys(text, min_chars)
                    if keys:
                        hit = _is_set(bits, _cells(keys, cells)).all(axis=1)
                        keys = [k for k, h in zip(keys, hit, strict=True) if h]
                    out.append(keys)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, pa.list_(pa.binary()))], ["id", "keys"])

    return run


def _rewrite(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                texts, n_lines, n_dropped = [], [], []
                for text, drop in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    gone = set(drop or ())
                    stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                    texts.append("\n".join(stay))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                    ["id", "text", "n_lines", "n_dropped"],
                )

    return run


def line_dedup(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int = 3, min_chars: int = 20, cells: int = 1 << 24
) -> DataFrame:
    """Documents without repeated lines: (id, text, n_lines, n_dropped).

    Texts are split at \\n; null and empty texts are one empty line. A line's key is the line without ASCII
    white space at both ends, A-Z lower-cased. Keys of ``min_chars`` characters or more that ``min_docs``
    documents hold lose all their lines except in the largest id that holds them, where all of the key's
    lines stay. Each row counts as a document; rows with equal ids count apart but keep or lose lines
    together, and null ids rank below all others.

    Every task fills two Bloom filters of ``cells`` bits, for keys seen once and seen twice; their sums mark
    the suspects. Only hashes (128 bits) of suspected lines are shuffled to be counted exactly. The filters
    have a fixed size: where they fill up, more lines are suspected and counted, with the same result.
    Other columns are ignored. An empty table gives an empty result.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    twice = spark.sparkContext.broadcast(seen_twice(base, "text", min_chars, cells))
    id_type = base.schema["id"].dataType.simpleString()
    suspects = base.mapInArrow(_suspect(twice, cells, min_chars), f"id {id_type}, keys array<binary>")
    lines = store(suspects.select("id", F.explode("keys").alias("key")), "lines")

    counted = lines.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
    # Written out, so that both sides of the join are plain tables and a very common line can be split among tasks.
    repeated = store(counted.where(F.col("n") >= min_docs).select("key", "keep"), "repeated")
    lost = lines.join(repeated, "key").where(~F.col("id").eqNullSafe(F.col("keep"))).select("id", "key")
    drops = (
        lost.groupBy("id")
        .agg(F.collect_set("key").alias("drop"))
        .withColumnRenamed("id", "drop_id")
    )
    joined = base.join(drops, F.col("id").eqNullSafe(F.col("drop_id")), "left").select("id", "text", "drop")
    done = joined.mapInArrow(_rewrite(min_chars), f"id {id_type}, text string, n_lines bigint, n_dropped bigint")
    return done.withColumnRenamed("id", id_col)
