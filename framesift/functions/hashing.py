"""64-bit difference hashes: from a grid, to and from text, and their distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.schema import HASH_BITS


def hash_bits(text: Column) -> Column:
    """A hash of 1 to 16 hex digits as a long; null for other text. Compare by bits only: the sign is a bit."""
    good = F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), text)
    return F.conv(good, 16, -10).cast("bigint")


def hash_text(bits: Column) -> Column:
    """A hash as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def distance(left: Column, right: Column) -> Column:
    """Differing bits of two hash texts; 64 if either can't be read."""
    return F.coalesce(F.bit_count(hash_bits(left).bitwiseXOR(hash_bits(right))), F.lit(HASH_BITS)).cast("int")


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Brightness of a pixel in whole numbers."""
    return F.floor((2126 * red + 7152 * green + 722 * blue) / F.lit(10_000)).cast("int")


def difference_hash(grid: Column, width: int = 9, height: int = 8) -> Column:
    """The hash of a grid in row order: bit y * (width - 1) + x is set where a cell is above its right neighbour."""
    cells = [(y * width + x, y * (width - 1) + x) for y in range(height) for x in range(width - 1)]
    bits = [F.when(grid[cell] > grid[cell + 1], F.lit(1 << bit if bit < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for cell, bit in cells]
    while len(bits) > 1:  # a tree of ORs, not a chain, so that the expression stays shallow
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])] + ([bits[-1]] if len(bits) % 2 else [])
    return bits[0]
