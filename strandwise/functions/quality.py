"""Phred qualities as column expressions on ASCII codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_of(q: int) -> int:
    """``remap8`` of one code, for building tables."""
    return 7 if q > 0x37 else 0 if q < 0x25 else 1 + (q - 0x25) // 3


def remap8(q: Column) -> Column:
    """Eight levels: 0 below 0x25, 7 above 0x37, six steps of three between."""
    return F.when(q > 0x37, 7).when(q < 0x25, 0).otherwise(1 + F.floor((q - 0x25) * 6 / 18)).cast("int")


def probability(q: Column, least: int) -> Column:
    """Error probability 10^((least - q) / 10), in signed arithmetic."""
    return F.pow(F.lit(10.0), (F.lit(least) - q) / F.lit(10.0))
