"""64-bit perceptual hashes: text form, bit form and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_bits(text) -> Column:
    """16 hex digits as the BIGINT with the same 64 bits.

    The two halves are parsed apart: the upper half of the unsigned range overflows a BIGINT.
    """
    text = _col(text)
    high = F.conv(F.substring(text, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(text, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def bits_to_hex(bits) -> Column:
    return F.lower(F.lpad(F.hex(_col(bits)), 16, "0"))


def hamming(a, b) -> Column:
    """Number of bits in which two BIGINT bit patterns differ."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def hamming_hex(a, b) -> Column:
    return hamming(hex_to_bits(a), hex_to_bits(b))
