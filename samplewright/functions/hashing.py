"""Reproducible randomness from md5 digests.

``rand``/``randn`` change when a task is retried or the input is split differently; a digest of
(seed, stream, row) does not, and any SQL engine with md5 can recompute it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS = 60
WORD = 1 << 32
HALF_KEY = 1 << 30


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by ':'; a null part gives null."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    joined = [texts[0]]
    for text in texts[1:]:
        joined += [F.lit(":"), text]
    return F.md5(F.concat(*joined))


def _hex_to_bigint(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def _key_at(md5: Column, start: int) -> Column:
    return _hex_to_bigint(F.substring(md5, start, KEY_BITS // 4))


def hash_key(*parts: Column | str | int) -> Column:
    """60-bit key in [0, 2**60) for shuffling rows."""
    return _key_at(digest(*parts), 1)


def hash_word(*parts: Column | str | int) -> Column:
    """32-bit word in [0, 2**32)."""
    return _hex_to_bigint(F.substring(digest(*parts), 1, 8))


def uniform_int(word: Column, n: int) -> Column:
    """Scales a 32-bit word to [0, n) in whole numbers."""
    if not 0 < n < 1 << 31:
        raise ValueError("n must be in [1, 2**31)")
    return F.shiftright(word * F.lit(n).cast("bigint"), 32).cast("int")


def normal_vector(seed: int, row: Column, size: int) -> Column:
    """``size`` independent N(0,1) values for a row id.

    The two halves of a digest give a 60-bit key each, a key two 30-bit words, and two words a Box-Muller
    pair: four values per digest.
    """
    digests = F.transform(F.sequence(F.lit(0), F.lit((size + 3) // 4 - 1)), lambda b: digest(seed, "noise", row, b))
    keys = F.flatten(F.transform(digests, lambda d: F.array(_key_at(d, 1), _key_at(d, 17))))
    pairs = F.transform(keys, _polar)
    values = F.transform(pairs, lambda p: F.array(p["r"] * F.cos(p["angle"]), p["r"] * F.sin(p["angle"])))
    return F.slice(F.flatten(values), 1, size)


def _polar(key: Column) -> Column:
    """Radius and angle from the two 30-bit words of a key."""
    u = (F.shiftright(key, 30) + 1) / F.lit(float(HALF_KEY))
    turn = key.bitwiseAND(F.lit(HALF_KEY - 1)) / F.lit(float(HALF_KEY))
    return F.struct(F.sqrt(F.log(u) * -2.0).alias("r"), (turn * F.lit(2 * math.pi)).alias("angle"))
