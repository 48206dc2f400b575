"""Hashes of k-mers.

The 32-bit integer hash and ntHash are column expressions; what needs wrapping 64-bit products runs in
Arrow batches.  Unsigned 64-bit values are held in longs; ``unsigned_less`` compares them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: ntHash seeds of the four bases, and the constants of its multi-hash extension (fixed values).
NT_SEEDS = {"A": 0x3C8BFBB395C60474, "C": 0x3193C18562A02B4C, "G": 0x20323ED082572324, "T": 0x295549F54BE24456}
NT_MULTI_SEED, NT_MULTI_SHIFT = 0x90B45D39FB6DA1FA, 27
_M = 0xFFFFFFFF


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _rotl(x: int, r: int) -> int:
    r %= 64
    return ((x << r) | (x >> (64 - r))) & ((1 << 64) - 1)


def inv32(code: Column) -> Column:
    """Invertible 32-bit integer mix of a code below 2^32."""
    m = F.lit(_M).cast("long")
    k = (m - code + code * 32768).bitwiseAND(m)
    k = k.bitwiseXOR(F.shiftrightunsigned(k, 12))
    k = (k + k * 4).bitwiseAND(m)
    k = k.bitwiseXOR(F.shiftrightunsigned(k, 4))
    k = (k * 2057).bitwiseAND(m)
    return k.bitwiseXOR(F.shiftrightunsigned(k, 16))


def inv32_of(code: np.ndarray) -> np.ndarray:
    """``inv32`` of an array of codes."""
    m = np.uint64(_M)
    with np.errstate(over="ignore"):
        k = (m - code + code * np.uint64(32768)) & m
        k ^= k >> np.uint64(12)
        k = (k + k * np.uint64(4)) & m
        k ^= k >> np.uint64(4)
        k = (k * np.uint64(2057)) & m
    return k ^ k >> np.uint64(16)


def nthash(seq: Column, k: int, reverse: bool = False) -> Column:
    """ntHash of the first ``k`` bases: XOR of each base's seed rotated by its place.

    Written out over the ``k`` places with rotated seeds as constants, so it needs no lambda.
    """
    out = F.lit(0).cast("long")
    for i in range(k):
        base = F.substring(seq, i + 1, 1)
        if reverse:
            seeds = {b: _signed(_rotl(NT_SEEDS[c], i)) for b, c in zip("ACGT", "TGCA", strict=True)}
        else:
            seeds = {b: _signed(_rotl(s, k - 1 - i)) for b, s in NT_SEEDS.items()}
        value = F.when(base == "A", seeds["A"]).when(base == "C", seeds["C"]).when(base == "G", seeds["G"]).otherwise(seeds["T"])
        out = out.bitwiseXOR(value)
    return out


def unsigned_less(a: Column, b: Column) -> Column:
    low = F.lit(-(1 << 63)).cast("long")
    return a.bitwiseXOR(low) < b.bitwiseXOR(low)


def nthash_canonical(forward: Column, reverse: Column) -> Column:
    """(hash, strand): the unsigned minimum of both strands; on a tie strand 0."""
    back = unsigned_less(reverse, forward)
    return F.struct(F.when(back, reverse).otherwise(forward).alias("hash"), back.cast("int").alias("strand"))


def unsigned_text(h: Column) -> Column:
    """A long read as unsigned, in 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def mix64(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit integer mix, vectorised with wrapping arithmetic."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = ~x + (x << np.uint64(21))
        x ^= x >> np.uint64(24)
        x = x + (x << np.uint64(3)) + (x << np.uint64(8))
        x ^= x >> np.uint64(14)
        x = x + (x << np.uint64(2)) + (x << np.uint64(4))
        x ^= x >> np.uint64(28)
        x = x + (x << np.uint64(31))
    return x


@F.pandas_udf(LongType())
def inv64(code: pd.Series) -> pd.Series:
    """Invertible 64-bit hash of a code, as a signed long."""
    return pd.Series(mix64(code.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def nthash_multi(k: int, m: int):
    """Arrow function: ``m`` hashes from one, the first unchanged."""

    @F.pandas_udf(ArrayType(LongType()))
    def run(h: pd.Series) -> pd.Series:
        x = h.to_numpy(np.int64).view(np.uint64)
        out = [x]
        with np.errstate(over="ignore"):
            for i in range(1, m):
                t = x * np.uint64((i ^ (k * NT_MULTI_SEED)) & ((1 << 64) - 1))
                out.append(t ^ (t >> np.uint64(NT_MULTI_SHIFT)))
        return pd.Series(list(np.stack(out, 1).view(np.int64)))

    return run


def byte_swapped32(code: Column) -> Column:
    """What a hasher gives that reads a 32-bit value's bytes in the other order."""
    b = [F.shiftrightunsigned(code, 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    return F.shiftleft(b[0], 24).bitwiseOR(F.shiftleft(b[1], 16)).bitwiseOR(F.shiftleft(b[2], 8)).bitwiseOR(b[3]).cast("long")


def partition_of(code: Column, n: int) -> Column:
    """Which of ``n`` counters a k-mer goes to."""
    return (inv32(code) % n).cast("int")
