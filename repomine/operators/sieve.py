"""A filter of fixed size that keeps the rows of wanted keys, for key sets too large to broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a sieve: 16 MB as bitmaps, however many keys there are. With 13 million keys nine of ten other rows go.
SIEVE_BITS = 1 << 27
# Fixed value: bits of a bitmap that Spark's bitmap functions build.
BITMAP_BITS = 8 * 4096


def _bit(on: Sequence[str], bits: int) -> Column:
    """Number of the key's bit, from 1 as the bitmap functions count."""
    return F.pmod(F.xxhash64(*on), F.lit(bits)) + 1


def key_sieve(keys: DataFrame, on: Sequence[str], bits: int = SIEVE_BITS) -> DataFrame:
    """Bitmaps of the hashes of the keys, one row per group of bits that has any.

    Bitmaps are combined before the shuffle, and at most ``bits / 32768`` rows of 4 KB come out of it.
    """
    if bits % BITMAP_BITS:
        raise ValueError(f"the bits of a sieve are a multiple of {BITMAP_BITS}")
    placed = keys.select(_bit(on, bits).alias("bit"))
    return placed.groupBy(F.bitmap_bucket_number("bit").alias("sieve_group")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("sieve_bits")
    )


def sift(table: DataFrame, sieve: DataFrame, on: Sequence[str], bits: int = SIEVE_BITS) -> DataFrame:
    """Rows of the table whose key may be among those of the sieve: all that are, and a few others.

    The keys must have the types of those in the sieve, since equal values of other types hash differently. The
    sieve's size is fixed ahead, so it is broadcast unmeasured; the table is not shuffled.
    """
    bit = _bit(on, bits)
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("sieve_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return table.join(F.broadcast(sieve), (F.bitmap_bucket_number(bit) == F.col("sieve_group")) & held, "left_semi")
