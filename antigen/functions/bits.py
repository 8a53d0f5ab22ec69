"""Binary patterns as bit masks in a BIGINT, and the distances between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(bits: Sequence[Column]) -> Column:
    """The mask whose bit i is set where bits[i] is true; a null counts as false. Up to 62 bits."""
    total = F.lit(0).cast("bigint")
    for i, bit in enumerate(bits):
        total = total + F.when(bit, F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return total


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def weight_of(mask: Column, weights: Sequence[float]) -> Column:
    """The sum of the weights of a mask's set bits: one array look-up for each byte."""
    total = F.lit(0.0)
    for start in range(0, len(weights), 8):
        part = weights[start : start + 8]
        sums = [sum(w for i, w in enumerate(part) if byte >> i & 1) for byte in range(1 << len(part))]
        byte = F.shiftright(mask, start).bitwiseAND(F.lit(len(sums) - 1).cast("bigint")).cast("int")
        total = total + F.element_at(F.array(*map(F.lit, sums)), byte + 1)
    return total


def weighted_hamming(a: str, b: str, weights: Sequence[float]) -> Column:
    return weight_of(F.col(a).bitwiseXOR(F.col(b)), weights)


def jaccard(a: str, b: str) -> Column:
    """Shared set bits by set bits of either; 0 where neither has any."""
    either = F.bit_count(F.col(a).bitwiseOR(F.col(b)))
    return F.when(either == 0, 0.0).otherwise(F.bit_count(F.col(a).bitwiseAND(F.col(b))) / either)


def normalized(weights: Sequence[float]) -> list[float]:
    """Weights that sum to 1; equal ones if all are 0. Negative or missing weights are an error."""
    if any(w is None or w != w or w < 0 for w in weights):
        raise ValueError("weights are to be finite and not negative")
    total = sum(weights)
    return [w / total for w in weights] if total > 0 else [1 / len(weights)] * len(weights)
