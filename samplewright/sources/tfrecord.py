"""``format("tfrecord")``: length-framed record files holding example messages.

Frame: length (uint64), masked CRC-32C of the length, payload, masked CRC-32C of the payload, all
little-endian.

A file is read in byte ranges, so one huge file does not become one task. A range begins at the first
offset whose 12 bytes are a length and its checksum. A chance match inside a payload would be seen by
the reader of the range before, which knows the true record limits and fails the job rather than let
both read on; ``splitBytes=0`` then reads each file in one piece.

Columns are features of the messages, but for four: ``_shard STRING`` and ``_offset BIGINT``, the file and the
byte at which a record begins, which together identify it, ``_corrupt_record``, and ``_reason STRING``, why it is one.

A path without a scheme is a local one; name the scheme on a cluster.

Options: ``path``, ``pathGlobFilter`` (default ``*.tfrecords``), ``splitBytes``, ``verifyCrc``,
``mode`` (``FAILFAST``, or ``PERMISSIVE`` with a ``_corrupt_record BINARY`` column for payloads that
cannot be decoded), ``imageBytes`` (required length of ``image_raw``).
"""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from .crc32c import masked_crc32c, masked_crc32c_of_windows
from .example import decode_example, encode_example

SCHEMA = "image_raw BINARY NOT NULL, label BIGINT NOT NULL"
CORRUPT, REASON, SHARD, OFFSET = "_corrupt_record", "_reason", "_shard", "_offset"
HEADER = 12
TRAILER = 4
DEFAULT_SPLIT = 128 << 20
BATCH_BYTES = 16 << 20
SCAN_BYTES = 1 << 20
READ_BYTES = 8 << 20


class RecordError(ValueError):
    """A record file that cannot be read as asked."""


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    size: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _shards(path: str, pattern: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    filesystem, root = _open(path)
    if filesystem.get_file_info(root).type == fs.FileType.File:
        return filesystem, [filesystem.get_file_info(root)]
    found = filesystem.get_file_info(fs.FileSelector(root))
    files = [f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    return filesystem, sorted(files, key=lambda f: f.path)


class TFRecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TFRecordReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TFRecordWriter(schema, dict(self.options), overwrite)


def _feature_types(schema: T.StructType) -> dict[str, type]:
    kinds = {}
    for field in schema.fields:
        if field.name in (CORRUPT, REASON, SHARD, OFFSET):
            wanted = {SHARD: T.StringType, REASON: T.StringType, OFFSET: T.LongType}.get(field.name)
            if wanted and not isinstance(field.dataType, wanted):
                raise RecordError(f"column {field.name} must be {wanted().simpleString()}")
            continue
        if isinstance(field.dataType, T.BinaryType):
            kinds[field.name] = bytes
        elif isinstance(field.dataType, T.LongType):
            kinds[field.name] = int
        else:
            raise RecordError(f"column {field.name}: features are BINARY or BIGINT")
    return kinds


def _option(options: dict, name: str, default):
    return {k.lower(): v for k, v in options.items()}.get(name.lower(), default)


class TFRecordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.wanted = schema, _feature_types(schema)
        self.path = _option(options, "path", None)
        if not self.path:
            raise RecordError("no path given")
        self.pattern = _option(options, "pathGlobFilter", "*.tfrecords")
        self.split = int(_option(options, "splitBytes", DEFAULT_SPLIT))
        self.verify = str(_option(options, "verifyCrc", "true")).lower() == "true"
        image_bytes = _option(options, "imageBytes", None)
        self.image_bytes = int(image_bytes) if image_bytes else None
        self.mode = str(_option(options, "mode", "FAILFAST")).upper()
        if self.mode not in ("FAILFAST", "PERMISSIVE"):
            raise RecordError(f"unknown mode {self.mode}")
        if self.mode == "PERMISSIVE" and CORRUPT not in schema.names:
            raise RecordError(f"PERMISSIVE needs a {CORRUPT} BINARY column in the schema")

    def partitions(self) -> Sequence[InputPartition]:
        _, files = _shards(self.path, self.pattern)
        if not files:
            raise RecordError(f"no {self.pattern} below {self.path}")
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out = []
        for info in files:
            # from_uri strips the scheme from the listing.
            path = scheme + info.path if scheme and "://" not in info.path else info.path
            step = self.split if self.split > 0 else max(info.size, 1)
            out += [ByteRange(path, at, min(at + step, info.size), info.size) for at in range(0, max(info.size, 1), step)]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        filesystem, path = _open(partition.path)
        with filesystem.open_input_file(path) as file:
            rows, held = [], 0
            for at, payload, intact in self._payloads(file, partition):
                rows.append(self._row(payload, intact, partition.path) | {SHARD: partition.path, OFFSET: at})
                held += len(payload)
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _payloads(self, file, part: ByteRange) -> Iterator[tuple[int, bytes, bool]]:
        at = part.start if part.start == 0 else _first_record(file, part.start, part.end, part.size)
        if at is None:
            return
        blocks = _Blocks(file, part.end)
        while at < part.end and at < part.size:
            header = blocks.read(at, HEADER)
            if len(header) < HEADER:
                raise RecordError(f"{part.path}: truncated header at byte {at}")
            length = int.from_bytes(header[:8], "little")
            if masked_crc32c(header[:8]) != int.from_bytes(header[8:], "little"):
                raise RecordError(f"{part.path}: bad length checksum at byte {at}")
            if at + HEADER + length + TRAILER > part.size:
                raise RecordError(f"{part.path}: truncated record at byte {at}")
            framed = blocks.read(at + HEADER, length + TRAILER)
            payload, trailer = framed[:length], framed[length:]
            intact = not self.verify or masked_crc32c(payload) == int.from_bytes(trailer, "little")
            if not intact and self.mode == "FAILFAST":
                raise RecordError(f"{part.path}: bad payload checksum at byte {at}")
            yield at, payload, intact
            at += HEADER + length + TRAILER
        if part.end < at and _first_record(file, part.end, at, part.size) is not None:
            raise RecordError(f"{part.path}: a payload looks like records near byte {part.end}; read with splitBytes=0")

    def _row(self, payload: bytes, intact: bool, path: str) -> dict:
        try:
            if not intact:
                raise RecordError("bad payload checksum")
            row = decode_example(payload, self.wanted)
            image = row.get("image_raw")
            if self.image_bytes is not None and image is not None and len(image) != self.image_bytes:
                raise RecordError(f"image_raw has {len(image)} bytes, not {self.image_bytes}")
            return row
        except ValueError as fault:
            if self.mode == "FAILFAST":
                raise RecordError(f"{path}: {fault}") from fault
            return {CORRUPT: payload, REASON: str(fault)}

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        arrow = to_arrow_schema(self.schema)
        return pa.RecordBatch.from_arrays(
            [pa.array([row.get(f.name) for row in rows], f.type) for f in arrow], names=arrow.names
        )


class _Blocks:
    """Reads a file in large blocks: an object store answers few requests, not three for each record."""

    def __init__(self, file, end: int):
        self.file, self.end = file, end
        self.start, self.data = 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.start <= at or at + n > self.start + len(self.data):
            self.file.seek(at)
            # Past the end of the range only as far as its last record reaches.
            self.start, self.data = at, self.file.read(max(n, min(READ_BYTES, self.end - at)))
        return self.data[at - self.start:at - self.start + n]


def _first_record(file, start: int, end: int, size: int) -> int | None:
    """First offset in [start, end) that holds a length and its checksum."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(min(SCAN_BYTES, end - at) + HEADER - 1)
        count = len(data) - HEADER + 1
        if count <= 0:
            return None
        raw = np.frombuffer(data, dtype=np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(raw, 4)[8:8 + count]
        stored = np.ascontiguousarray(words).view("<u4").ravel()
        for hit in np.flatnonzero(masked_crc32c_of_windows(data[:count + 7], 8) == stored):
            length = int.from_bytes(data[hit:hit + 8], "little")
            if at + int(hit) + HEADER + length + TRAILER <= size:
                return at + int(hit)
        at += count
    return None


@dataclass
class Written(WriterCommitMessage):
    pending: str


class TFRecordWriter(DataSourceArrowWriter):
    """One file per task. Files become visible under their shard name only when the job commits."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.names = list(_feature_types(schema))
        self.path = _option(options, "path", None)
        if not self.path:
            raise RecordError("no path given")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        filesystem, root = _open(self.path)
        pending = f"{root}/_pending-{self.job}"
        filesystem.create_dir(pending)
        target = f"{pending}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        with filesystem.open_output_stream(target) as out:
            for batch in iterator:
                for row in batch.select(self.names).to_pylist():
                    if any(value is None for value in row.values()):
                        raise RecordError("a feature must not be null")
                    payload = encode_example(row)
                    length = len(payload).to_bytes(8, "little")
                    out.write(length + masked_crc32c(length).to_bytes(4, "little"))
                    out.write(payload + masked_crc32c(payload).to_bytes(4, "little"))
        return Written(target)

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, root = _open(self.path)
        replaced = _shards(self.path, "*.tfrecords")[1] if self.overwrite else []
        for message in messages:
            if message is not None:
                filesystem.move(message.pending, f"{root}/{os.path.basename(message.pending)}.tfrecords")
        # Last, so that a failure on the way leaves old and new files, not neither.
        for old in replaced:
            filesystem.delete_file(old.path)
        self._clear(filesystem, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, filesystem: fs.FileSystem, root: str) -> None:
        pending = f"{root}/_pending-{self.job}"
        if filesystem.get_file_info(pending).type == fs.FileType.Directory:
            filesystem.delete_dir(pending)
