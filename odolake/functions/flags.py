"""Bit tests on the sample tables' flag columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHONE_FIX = 32
SCAN_LEARNING = 1

BOOT = ["vehicle_id", "boot_id"]


def has_bit(col: str, bit: int) -> Column:
    """True when the bit is set; a NULL bitmap has no bit set."""
    return F.coalesce(F.col(col), F.lit(0)).bitwiseAND(bit) != 0


def from_phone() -> Column:
    return has_bit("source_flags", PHONE_FIX)


def from_device() -> Column:
    return ~from_phone()
