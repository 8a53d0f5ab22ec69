"""Hashes that any engine with md5 can repeat, so that samples can be checked elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_hash(seed: int | str | Column, *ids: str | Column) -> Column:
    """A number from 0 to 2^32 - 1 by a seed and an id, from the first 8 hex digits of an md5."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", first.cast("string"), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def wide_hash(seed: int | str | Column, *ids: str | Column) -> Column:
    """The first 16 hex digits of the md5 of a seed and an id: 64 bits, whose order as text is that of the number."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.substring(F.md5(F.concat_ws("|", first.cast("string"), *(F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids))), 1, 16)


def mixed(hash16: Column, seed: int) -> Column:
    """A 64-bit hash of hex digits, xor the seed times 0x9E3779B1 modulo 2^64."""
    word = seed * 0x9E3779B1 % (1 << 64)
    number = F.conv(hash16, 16, -10).cast("bigint").bitwiseXOR(F.lit(word - (1 << 64) if word >> 63 else word).cast("bigint"))
    return F.lpad(F.lower(F.hex(number)), 16, "0")
