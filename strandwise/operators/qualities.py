"""Compressed qualities and lookups in them (tables in place of a network service).

A read's levels are a string of digits 0 to 7: one byte a base, packed further by Parquet's encodings, and
cut out by position without touching the rest of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import level_of

_PRINTABLE = "".join(map(chr, range(0x20, 0x7F)))
_LEVELS = "".join(str(level_of(ord(c))) for c in _PRINTABLE)


def compress(quals: DataFrame) -> DataFrame:
    """(seq_id, q8): each read's levels; qualities are printable ASCII."""
    return quals.filter("qual IS NOT NULL").select("seq_id", F.translate("qual", _PRINTABLE, _LEVELS).alias("q8"))


def decompress(compressed: DataFrame) -> DataFrame:
    """(seq_id, pos, q8): a row for each base."""
    rows = compressed.select("seq_id", F.posexplode(F.regexp_extract_all("q8", F.lit("(.)"), F.lit(1))).alias("pos", "q8"))
    return rows.withColumn("q8", F.col("q8").cast("int"))


def describe(compressed: DataFrame) -> DataFrame:
    """(seq_id, len, bits): length, and bits of the largest level."""
    q = F.col("q8")
    bits = F.when(F.length(q) == 0, 0).when(q.rlike("[4-7]"), 3).when(q.rlike("[23]"), 2).otherwise(1)
    return compressed.select("seq_id", F.length(q).alias("len"), bits.alias("bits"))


def read_block(compressed: DataFrame, begin: int, end: int) -> DataFrame:
    """(seq_id, q8): levels [begin, end) of each read, as far as it goes."""
    if not 0 <= begin < end:
        raise ValueError("begin must be at least 0 and below end")
    return compressed.select("seq_id", F.substring("q8", begin + 1, end - begin).alias("q8"))


def read_one(compressed: DataFrame, seq_id: int) -> DataFrame:
    return compressed.filter(F.col("seq_id") == seq_id)
