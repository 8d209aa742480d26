"""Hash expressions that give the same value in every run, partitioning and SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fraction(text: str | Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-256 as a number in [0, 1); exact for up to 13 digits."""
    return F.conv(F.substring(F.sha2(col(text), 256), 1, digits), 16, 10).cast("bigint") / F.lit(16.0**digits)


def stable_fraction(seed: int, namespace: str, key: str | Column) -> Column:
    """Fraction of ``seed:namespace:key``."""
    return fraction(F.concat(F.lit(f"{seed}:{namespace}:"), col(key).cast("string")))


def hex16(text: str | Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256; fixed width, so it sorts like the unsigned number."""
    return F.substring(F.sha2(col(text), 256), 1, 16)


def bits64(hex_digits: str | Column) -> Column:
    """16 hexadecimal digits as the bits of a bigint; null unless it is exactly 16 of them."""
    h = col(hex_digits)
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("bigint"))


def hamming(a: str | Column, b: str | Column) -> Column:
    """Number of differing bits of two bigints."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))
