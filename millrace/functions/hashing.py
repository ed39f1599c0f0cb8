"""Integer hash functions as column expressions, and the same in DuckDB SQL. Unsigned 32-bit values are longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
#: Fixed values of the 32-bit Murmur3 finaliser.
MURMUR = (0x85EBCA6B, 0xC2B2AE35)


def multiply32(x: Column, by: int) -> Column:
    """The low 32 bits of a product; in halves, as the whole would pass 63 bits."""
    high = F.shiftleft((F.shiftrightunsigned(x, 16) * by).bitwiseAND(F.lit(0xFFFF)), 16)
    return (high + x.bitwiseAND(F.lit(0xFFFF)) * by).bitwiseAND(F.lit(MASK))


def murmur32(x: Column) -> Column:
    """The finaliser of 32-bit Murmur3 on the low 32 bits of x."""
    h = x.cast("long").bitwiseAND(F.lit(MASK))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    h = multiply32(h, MURMUR[0])
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = multiply32(h, MURMUR[1])
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def murmur32_sql(x: str) -> str:
    h = f"(({x})::HUGEINT & {MASK})"
    for shift, by in ((16, MURMUR[0]), (13, MURMUR[1])):
        h = f"((xor({h}, {h} >> {shift}) * {by}) & {MASK})"
    return f"(xor({h}, {h} >> 16))::BIGINT"


def shift_hash(x: Column, bits: int = 24) -> Column:
    return F.shiftrightunsigned(x, bits)


def scramble(x: Column) -> Column:
    """A distinct, sparse 32-bit key for each x below 2^32: times an odd number."""
    return multiply32(x.cast("long"), 2654435761)


def scramble_sql(x: str) -> str:
    return f"((({x})::HUGEINT * 2654435761) & {MASK})::BIGINT"


def draw(x: Column) -> Column:
    """The next of a linear congruential sequence."""
    return (x.cast("long") * 48271 + 11) % 2147483647


def draw_sql(x: str) -> str:
    return f"((({x})::BIGINT * 48271 + 11) % 2147483647)"
