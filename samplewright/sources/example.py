"""The few protobuf fields of an example record: named features holding bytes or int64 values.

Wire layout (public format): Example.features = 1, Features.feature = 1 (map entry: key = 1,
value = 2), Feature.bytes_list = 1, Feature.int64_list = 3, list values = 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: memoryview) -> Iterator[tuple[int, memoryview | int]]:
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("example ends inside a field")
            value, at = data[at:at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at:at + size], at + size
        else:
            raise ValueError(f"unknown wire type {wire}")
        yield tag >> 3, value


def _int64s(data: memoryview) -> Iterator[int]:
    for number, value in _fields(data):
        if number != 1:
            continue
        if isinstance(value, int):
            packed = [value]
        else:
            packed, at = [], 0
            while at < len(value):
                one, at = _varint(value, at)
                packed.append(one)
        for one in packed:
            yield one - (1 << 64) if one >= 1 << 63 else one


def decode_example(payload: bytes, wanted: Mapping[str, type]) -> dict[str, bytes | int]:
    """The wanted features, each a single value of type ``bytes`` or ``int``; all must be there."""
    found: dict[str, bytes | int] = {}
    try:
        for number, features in _fields(memoryview(payload)):
            if number != 1:
                continue
            for entry_number, entry in _fields(features):
                if entry_number != 1:
                    continue
                parts = dict(_fields(entry))
                name = bytes(parts.get(1, b"")).decode("utf-8")
                if name not in wanted:
                    continue
                lists = dict(_fields(parts.get(2, memoryview(b""))))
                if wanted[name] is bytes:
                    values = [bytes(v) for n, v in _fields(lists.get(1, memoryview(b""))) if n == 1]
                else:
                    values = list(_int64s(lists.get(3, memoryview(b""))))
                if len(values) != 1:
                    raise ValueError(f"feature {name!r} holds {len(values)} {wanted[name].__name__} values, not one")
                found[name] = values[0]
    except (IndexError, TypeError, UnicodeDecodeError) as fault:
        raise ValueError("malformed example") from fault
    missing = [name for name in wanted if name not in found]
    if missing:
        raise ValueError(f"missing feature {missing[0]!r}")
    return found


def _encode_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _message(number: int, body: bytes) -> bytes:
    return _encode_varint(number << 3 | 2) + _encode_varint(len(body)) + body


def encode_example(features: Mapping[str, bytes | int]) -> bytes:
    entries = b""
    for name, value in features.items():
        if isinstance(value, int):
            feature = _message(3, _message(1, _encode_varint(value)))
        else:
            feature = _message(1, _message(1, value))
        entries += _message(1, _message(1, name.encode("utf-8")) + _message(2, feature))
    return _message(1, entries)
