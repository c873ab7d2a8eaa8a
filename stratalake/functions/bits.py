"""Bit fields and little-endian numbers as column expressions, inside whole-stage code.

Numbers are signed 64-bit; a stored u64 above 2**63 - 1 wraps, so callers test for negatives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_LENGTH, MAX_MOFFSET, MAX_OFFSET


def byte_at(data: Column, place: Column | int) -> Column:
    """The byte at a place from 0, as a number."""
    return F.conv(F.hex(F.substring(data, place + 1 if isinstance(place, int) else place + F.lit(1), F.lit(1) if not isinstance(place, int) else 1)), 16, 10).cast("long")


def load_le(data: Column, place: Column | int, size: int) -> Column:
    """The little-endian number of `size` bytes at a place."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(byte_at(data, place + i), 8 * i) for i in range(size)])


def store_le(number: Column, size: int) -> Column:
    """`size` little-endian bytes of a number."""
    digits = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(size))))


def flag(flags: Column, bit: int) -> Column:
    return F.getbit(flags.cast("long"), F.lit(bit)) == 1


def words(offset: Column, length: Column, moffset: Column, zeroed: Column, tag: Column) -> tuple[Column, Column]:
    """A segment as two 64-bit words: offset 50 bits and length 14; moffset 55 bits, zeroed 1, tag 8."""
    low = offset.bitwiseAND(F.lit(MAX_OFFSET)).bitwiseOR(F.shiftleft(length.cast("long").bitwiseAND(F.lit(MAX_LENGTH)), 50))
    high = moffset.bitwiseAND(F.lit(MAX_MOFFSET)).bitwiseOR(F.shiftleft(zeroed.cast("long"), 55)).bitwiseOR(F.shiftleft(tag.cast("long"), 56))
    return low, high


def fields(low: Column, high: Column) -> dict[str, Column]:
    """The segment that two words hold."""
    return {
        "offset": low.bitwiseAND(F.lit(MAX_OFFSET)),
        "length": F.shiftrightunsigned(low, 50).bitwiseAND(F.lit(MAX_LENGTH)),
        "moffset": high.bitwiseAND(F.lit(MAX_MOFFSET)),
        "zeroed": F.getbit(high, F.lit(55)) == 1,
        "tag": F.shiftrightunsigned(high, 56).bitwiseAND(F.lit(255)).cast("int"),
    }


def load_segment(data: Column, place: Column | int) -> dict[str, Column]:
    return fields(load_le(data, place, 8), load_le(data, place + 8, 8))


def store_segment(offset: Column, length: Column, moffset: Column, zeroed: Column, tag: Column) -> Column:
    low, high = words(offset, length, moffset, zeroed, tag)
    return F.concat(store_le(low, 8), store_le(high, 8))


def div(a: Column, b: int) -> Column:
    """Integer quotient of non-negative numbers; exact, unlike a division of doubles."""
    return F.call_function("div", a, F.lit(b)) if b & (b - 1) else F.shiftright(a, b.bit_length() - 1)


def ceil_div(a: Column, b: int) -> Column:
    return div(a + F.lit(b - 1), b)


def round_up(a: Column, step: int) -> Column:
    return a + F.pmod(-a, F.lit(step))
