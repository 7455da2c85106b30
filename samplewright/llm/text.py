"""Column helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six white-space characters 0x20 and 0x09-0x0D.
SPACES = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; other characters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def unit_hash(*parts: Column | str | int) -> Column:
    """A number in (0, 1) that depends on the parts only, from 52 bits of MD5."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))
