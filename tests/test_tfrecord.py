"""Record files: format, splitting, modes and faults."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from samplewright.operators.raster import decode_bytes
from samplewright.sources import register
from samplewright.sources.crc32c import crc32c, masked_crc32c, masked_crc32c_of_windows
from samplewright.sources.example import decode_example, encode_example

SIZE = 64


def frame(payload: bytes, damage: str = "") -> bytes:
    length = len(payload).to_bytes(8, "little")
    head = length + masked_crc32c(length).to_bytes(4, "little")
    tail = masked_crc32c(payload).to_bytes(4, "little")
    if damage == "payload":
        payload = bytes([payload[0] ^ 1]) + payload[1:]
    if damage == "length":
        head = length + b"\0\0\0\0"
    return head + payload + tail


def image(i: int, size: int = SIZE) -> bytes:
    return bytes((i * 7 + j) % 256 for j in range(size))


def record(i: int) -> bytes:
    return encode_example({"image_raw": image(i), "label": i})


def write(folder, name: str, records) -> str:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as out:
        out.write(b"".join(records))
    return str(folder)


def read(spark, path, schema="image_raw BINARY NOT NULL, label BIGINT NOT NULL", **options):
    register(spark)
    return spark.read.format("tfrecord").schema(schema).options(**options).load(path)


@pytest.fixture
def shards(tmp_path):
    write(tmp_path, "a.tfrecords", [frame(record(i)) for i in range(10)])
    write(tmp_path, "b.tfrecords", [frame(record(i)) for i in range(10, 13)])
    write(tmp_path, "c.tfrecords", [])
    write(tmp_path, "notes.txt", [b"not a shard"])
    return str(tmp_path)


def test_crc_known_values():
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(b"\0" * 32) == 0x8A9136AA
    assert crc32c(b"") == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 1023, 1024, 1025, 3000])
def test_crc_matches_bitwise_definition(size):
    data = np.random.default_rng(size).bytes(size)
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    assert crc32c(data) == state ^ 0xFFFFFFFF


def test_crc_of_windows():
    data = np.random.default_rng(0).bytes(100)
    windows = masked_crc32c_of_windows(data, 8)
    assert windows.tolist() == [masked_crc32c(data[i:i + 8]) for i in range(93)]


@pytest.mark.parametrize("label", [0, 1, 127, 128, 2**40, -1, -(2**63)])
def test_example_round_trip(label):
    payload = encode_example({"image_raw": b"\0\xff" * 200, "label": label})
    assert decode_example(payload, {"image_raw": bytes, "label": int}) == {"image_raw": b"\0\xff" * 200, "label": label}


def test_reads_all_shards_and_only_them(spark, shards):
    rows = read(spark, shards).collect()
    assert sorted(r.label for r in rows) == list(range(13))
    assert all(bytes(r.image_raw) == image(r.label) for r in rows)


@pytest.mark.parametrize("split", [0, 1, 17, 100, 200, 10_000])
def test_any_split_size_gives_the_same_records(spark, shards, split):
    rows = read(spark, shards, splitBytes=str(split)).select("label").collect()
    assert sorted(r.label for r in rows) == list(range(13))


def test_columns_can_be_left_out(spark, shards):
    labels = read(spark, shards, schema="label BIGINT NOT NULL").collect()
    assert sorted(r.label for r in labels) == list(range(13))


def test_payload_holding_records_is_an_error_when_split(spark, tmp_path):
    inner = b"".join(frame(record(i)) for i in range(3))
    outer = encode_example({"image_raw": inner, "label": 1})
    path = write(tmp_path, "a.tfrecords", [frame(outer), frame(record(2))])
    with pytest.raises(PySparkException, match="looks like records"):
        read(spark, path, splitBytes="60").collect()
    assert sorted(r.label for r in read(spark, path, splitBytes="0").collect()) == [1, 2]


@pytest.mark.parametrize(
    "damage, message",
    [
        (frame(record(1), "payload"), "bad payload checksum"),
        (frame(record(1), "length"), "bad length checksum"),
        (frame(record(1))[:-5], "truncated record"),
        (frame(record(1))[:7], "truncated header"),
        (frame(encode_example({"image_raw": image(1)})), "missing feature 'label'"),
        (frame(encode_example({"label": 1})), "missing feature 'image_raw'"),
        (frame(encode_example({"image_raw": image(1, 63), "label": 1})), "63 bytes, not 64"),
        (frame(b"\xff\xff\xff"), "malformed example|unknown wire|ends inside"),
    ],
)
def test_damaged_files_fail(spark, tmp_path, damage, message):
    path = write(tmp_path, "a.tfrecords", [frame(record(0)), damage])
    with pytest.raises(PySparkException, match=message):
        read(spark, path, imageBytes=str(SIZE)).collect()


def test_permissive_mode_keeps_bad_payloads_apart(spark, tmp_path):
    bad = encode_example({"image_raw": image(1, 63), "label": 1})
    path = write(tmp_path, "a.tfrecords", [frame(record(0)), frame(bad), frame(record(2), "payload"), frame(record(3))])
    schema = "image_raw BINARY, label BIGINT, _corrupt_record BINARY"
    rows = read(spark, path, schema=schema, mode="PERMISSIVE", imageBytes=str(SIZE)).collect()
    assert sorted(r.label for r in rows if r._corrupt_record is None) == [0, 3]
    assert bad in [bytes(r._corrupt_record) for r in rows if r._corrupt_record is not None]
    assert len(rows) == 4


def test_no_shards_is_an_error(spark, tmp_path):
    with pytest.raises(PySparkException, match="no \\*.tfrecords"):
        read(spark, str(tmp_path)).collect()


def test_write_then_read(spark, tmp_path):
    register(spark)
    rows = spark.createDataFrame([(image(i), i) for i in range(50)], "image_raw BINARY, label BIGINT").repartition(5)
    path = str(tmp_path / "out")
    rows.write.format("tfrecord").mode("append").save(path)
    rows.write.format("tfrecord").mode("append").save(path)
    back = read(spark, path)
    assert sorted(r.label for r in back.collect()) == sorted(list(range(50)) * 2)
    rows.write.format("tfrecord").mode("overwrite").save(path)
    assert read(spark, path).count() == 50
    assert all(name.endswith(".tfrecords") for name in os.listdir(path))


def test_failed_write_leaves_nothing(spark, tmp_path):
    register(spark)
    rows = spark.createDataFrame([(image(0), 0), (image(1), None)], "image_raw BINARY, label BIGINT").repartition(2)
    path = tmp_path / "out"
    with pytest.raises(PySparkException, match="must not be null"):
        rows.write.format("tfrecord").mode("append").save(str(path))
    assert not path.exists() or os.listdir(path) == []


def test_decode_bytes_checks_length(spark):
    rows = spark.createDataFrame([(image(3),)], "b BINARY")
    assert rows.select(decode_bytes(F.col("b"), SIZE).alias("p")).first().p == list(image(3))
    with pytest.raises(PySparkException, match="expected 65 bytes"):
        rows.select(decode_bytes(F.col("b"), 65)).collect()


def test_records_are_identified_and_read_in_blocks(spark, tmp_path, monkeypatch):
    from samplewright.sources import register, tfrecord
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    register(spark)
    path = str(tmp_path / "records")
    rows = spark.range(200).select(F.lit(b"x" * 50).alias("image_raw"), F.col("id").alias("label"))
    rows.repartition(3).write.format("tfrecord").mode("append").save(path)
    schema = "label BIGINT, _shard STRING, _offset BIGINT"
    got = spark.read.format("tfrecord").schema(schema).option("splitBytes", 1000).load(path).collect()
    assert len(got) == 200 == len({(r._shard, r._offset) for r in got})
    assert len({r._shard for r in got}) == 3

    reads = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            reads.append(n)
            return self.file.read(n)

    reader = tfrecord.TFRecordReader(T._parse_datatype_string("label bigint"), {"path": path})
    for part in reader.partitions():
        filesystem, name = tfrecord._open(part.path)
        with filesystem.open_input_file(name) as file:
            assert list(reader._payloads(Counting(file), part))
    assert len(reads) == 3
