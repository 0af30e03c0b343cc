"""Bit functions on integral columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lowest_bit(x: Column) -> Column:
    """Value of the lowest set bit; 0 for 0."""
    return x.bitwiseAND(-x)


def highest_bit(x: Column, width: int = 64) -> Column:
    """Value of the highest set bit of a non-negative number; 0 for 0. Exact for all widths (bit smear)."""
    shift = 1
    while shift < width:
        x = x.bitwiseOR(F.shiftright(x, shift))
        shift *= 2
    return x - F.shiftright(x, 1)


def log2_of_power(x: Column) -> Column:
    """Exponent of a power of two; 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x - 1)).cast("int")


def reverse32(x: Column) -> Column:
    """The 32 low bits in reverse order, as a non-negative long."""
    return F.conv(F.reverse(F.lpad(F.bin(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), 32, "0")), 2, 10).cast("long")


def isolate(x: Column, offset: int, length: int) -> Column:
    """``length`` bits from bit ``offset`` on, in place."""
    mask = ((1 << length) - 1) << offset
    return x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def trailing_zeros(x: Column) -> Column:
    """Zeros below the lowest set bit; 64 for 0."""
    return F.when(x == 0, F.lit(64)).otherwise(F.bit_count(lowest_bit(x) - 1)).cast("int")
