"""Arrow helpers for kernels that cut texts into words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in pieces of about this many bytes, so that memory doesn't follow the batch size.
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in a text column; one long text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mapped_bytes(texts: pa.Array, table: bytes) -> pa.Array:
    """Texts with every byte looked up in ``table``, which must leave bytes above 127 alone; null becomes empty."""
    whole = pa.array(pc.fill_null(texts, ""), pa.large_string()) if texts.null_count or texts.offset else texts.cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if not len(whole):
        return whole
    data = whole.buffers()[2]
    raw = b"" if data is None else memoryview(data)[offsets[0] : offsets[-1]].tobytes().translate(table)
    shifted = np.ascontiguousarray(offsets - offsets[0])
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(shifted), pa.py_buffer(raw))


def word_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cuts at ASCII white space: (offsets of the texts' words, distinct words, index of each word)."""
    lists = pc.ascii_split_whitespace(texts)
    # Leading and trailing white space gives empty parts.
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = pc.index(distinct, pa.scalar("", distinct.type)).as_py()
    if empty >= 0:
        keep = index != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        index = index[keep]
    return offsets, distinct, index


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in distinct.to_pylist()], np.uint64)
