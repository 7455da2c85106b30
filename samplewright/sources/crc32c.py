"""CRC-32C (Castagnoli), vectorised over the bytes of a chunk.

A CRC is linear over XOR: the checksum of a chunk is the XOR of what each byte contributes, and a
contribution depends only on the byte and its distance from the end.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the public record-file format.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

CHUNK = 1024


def _contributions() -> np.ndarray:
    """Row d, column b: what byte b adds when d more bytes follow it in the chunk."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    out = np.empty((CHUNK, 256), dtype=np.uint32)
    out[0] = table
    for distance in range(1, CHUNK):
        out[distance] = (out[distance - 1] >> 8) ^ table[out[distance - 1] & 0xFF]
    return out


_BY_DISTANCE = _contributions()
_IN_ORDER = np.ascontiguousarray(_BY_DISTANCE[::-1]).ravel()
_OFFSETS = np.arange(CHUNK, dtype=np.int32) * 256
# The four bytes of the register, carried across one whole chunk.
_CARRY = [_BY_DISTANCE[CHUNK - 1 - at].tolist() for at in range(4)]


def crc32c(data: bytes) -> int:
    values = np.frombuffer(data, dtype=np.uint8)
    whole = len(values) // CHUNK
    state = 0xFFFFFFFF
    if whole:
        cells = values[:whole * CHUNK].reshape(whole, CHUNK) + _OFFSETS
        c0, c1, c2, c3 = _CARRY
        for folded in np.bitwise_xor.reduce(_IN_ORDER.take(cells), axis=1).tolist():
            state = folded ^ c0[state & 255] ^ c1[state >> 8 & 255] ^ c2[state >> 16 & 255] ^ c3[state >> 24]
    rest = values[whole * CHUNK:].copy()
    if len(rest):
        head = min(4, len(rest))
        rest[:head] ^= np.frombuffer(state.to_bytes(4, "little"), dtype=np.uint8)[:head]
        folded = int(np.bitwise_xor.reduce(_BY_DISTANCE[np.arange(len(rest) - 1, -1, -1), rest]))
        # A rest shorter than the register leaves part of the old state in place.
        state = folded ^ (state >> (8 * len(rest)) if len(rest) < 4 else 0)
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def masked_crc32c(data: bytes) -> int:
    return masked(crc32c(data))


def masked_crc32c_of_windows(data: bytes, size: int) -> np.ndarray:
    """Masked checksum of every ``size``-byte window of ``data`` (size of at least 4)."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), size)
    crc = np.zeros(len(windows), dtype=np.uint32)
    for at in range(size):
        crc ^= _BY_DISTANCE[size - 1 - at][windows[:, at] ^ (0xFF if at < 4 else 0)]
    crc ^= np.uint32(0xFFFFFFFF)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)
