"""Interleaved static range asymmetric numeral systems over numpy arrays.

A block holds ids under one shared table of frequencies. Its ids go round-robin to ``lanes`` coders that keep
64-bit states of their own and write 32-bit words to one stream. Decoding reads lane states and words in the
opposite order of encoding; checkpoints hold all lane states and the place in the stream every so many steps,
so that decoding can begin in the middle of a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: States stay in [2^31, 2^63); whole 32-bit words move to and from the stream.
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_WORD = np.uint64(0xFFFFFFFF)


@dataclass
class Frequencies:
    """Symbols with frequencies that add up to 2^bits. Symbols are those that occur, in ascending order."""

    symbols: np.ndarray
    counts: np.ndarray
    bits: int

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.uint64)
        self.place = np.zeros(int(self.symbols[-1]) + 1 if len(self.symbols) else 1, np.uint32)
        self.place[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)
        self.slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.counts.astype(np.int64))


def scaled(symbols: np.ndarray, counts: np.ndarray, least_bits: int = 16) -> Frequencies:
    """Frequencies in proportion to counts (all above 0), at least 1 each, adding up to a power of two.

    The power leaves at least eight places for each symbol on average.
    """
    bits = max(least_bits, int(np.ceil(np.log2(max(1, len(symbols)) * 8))))
    if bits > 31:
        raise ValueError("too many symbols")
    if not len(symbols):
        return Frequencies(np.array([0]), np.array([1 << bits], np.uint64), bits)
    room = (1 << bits) - len(symbols)
    exact = counts / counts.sum() * room
    share = np.floor(exact).astype(np.int64)
    left = room - int(share.sum())
    order = np.argsort(-(exact - share), kind="stable")
    share[order[:left]] += 1
    return Frequencies(np.asarray(symbols), (share + 1).astype(np.uint64), bits)


def lanes_for(n: int) -> int:
    """A power of two from 1 to 2048: about one lane for 256 ids."""
    return 1 << max(0, min(11, (n // 256).bit_length() - 1 if n >= 256 else 0))


def encode(ids: np.ndarray, table: Frequencies, lanes: int, checkpoint_steps: int) -> tuple[bytes, list[tuple[int, int, bytes]]]:
    """(payload, checkpoints). The payload is the lanes' final states and the words, in the order of reading.

    A checkpoint (step, words read, states) says how decoding stands before that step.
    """
    n = len(ids)
    steps = -(-n // lanes)
    places = table.place[ids]
    freq, start = table.counts[places], table.starts[places]
    shift = np.uint64(table.bits)
    limit_shift = np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []  # from the last step to the first
    marks: list[tuple[int, int, bytes]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        part = slice(step * lanes, min(n, (step + 1) * lanes))
        f, c = freq[part], start[part]
        x = state[: len(f)]
        full = x >= (f << limit_shift)
        if full.any():
            # Read in lane order, so written in the opposite one; the stream is turned round at the end.
            out = (x[full] & _WORD).astype(np.uint32)
            words.append(out)
            written += len(out)
            x = np.where(full, x >> _32, x)
        quotient = x // f
        state[: len(f)] = (quotient << shift) + (x - quotient * f) + c
        if step and step % checkpoint_steps == 0:
            marks.append((step, written, state.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    payload = state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()
    return payload, [(step, written - w, states) for step, w, states in reversed(marks)]


def decode(
    payload: bytes, n: int, table: Frequencies, lanes: int, checkpoint: tuple[int, int, bytes] | None = None, stop_step: int | None = None
) -> np.ndarray:
    """Ids of a block, or those from a checkpoint's step to ``stop_step``."""
    steps = -(-n // lanes)
    stop = steps if stop_step is None else min(stop_step, steps)
    head = lanes * 8
    stream = np.frombuffer(payload, "<u4", offset=head).astype(np.uint64)
    first, at, states = checkpoint if checkpoint else (0, 0, payload[:head])
    state = np.frombuffer(states, "<u8").astype(np.uint64)
    mask, shift = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    out = np.empty(max(0, min(n, stop * lanes) - first * lanes), np.uint32)
    filled = 0
    for step in range(first, stop):
        width = min(lanes, n - step * lanes)
        x = state[:width]
        slot = x & mask
        place = table.slots[slot]
        out[filled : filled + width] = place
        filled += width
        x = table.counts[place] * (x >> shift) + slot - table.starts[place]
        empty = x < LOW
        k = int(np.count_nonzero(empty))
        if k:
            x[empty] = (x[empty] << _32) | stream[at : at + k]
            at += k
        state[:width] = x
    return np.asarray(table.symbols, np.uint32)[out]
