"""Sliding windows over sequences: k-mers, ranges, blocks, slices, and their multiplicities.

A sequence's k-mers are taken in one linear pass (a look-ahead match at every base) and exploded from an
array, so the sequence is not copied beside each k-mer, and only k-mers ever reach a later shuffle.  Long
sequences are cut into overlapping chunks first, which bounds the arrays.  Sequences shorter than k (or
null) give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.hashing import NT_SEEDS

#: Bases of a chunk, and rows of a batch of rolling hashes.
CHUNK = 1 << 16
ROLL_ROWS = 1 << 16


def spread(seqs: DataFrame) -> DataFrame:
    """Sequences dealt by number over all shuffle partitions.

    A file may hold all its reads in one row group, and k-mers are many times the sequences: dealing the
    latter keeps all cores busy, and later groupings by sequence need no further exchange.
    """
    return seqs.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id")


def kmers(seqs: DataFrame, k: int, canonical: bool = False, begin: int = 0, end: int | None = None, keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """(seq_id, pos, kmer): every k-mer of [begin, end), or its canonical form.

    Canonical forms pair the k-mers of a chunk with those of its reverse complement in reverse order.
    ``dealt`` tells that ``seqs`` is spread over the cores already.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    part = F.col("seq")
    if begin or end is not None:
        part = part.substr(F.lit(begin + 1), F.lit((1 << 30) if end is None else max(0, end - begin)))
    src = seqs.select("seq_id", *keep, part.alias("seq"))
    src = src if dealt else spread(src)
    raw = F.encode("seq", "UTF-8")  # bytes are reached by offset, characters only by walking
    n = F.length("seq")
    many = F.transform(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), lambda p: F.substring(raw, p + 1, F.lit(CHUNK + k - 1)).cast("string"))
    rows = src.filter(n >= k).select("seq_id", *keep, F.posexplode(F.when(n <= CHUNK, F.array("seq")).otherwise(many)).alias("_chunk", "_seq"))
    every = F.lit(f"(?=(.{{{k}}})).")
    words = F.regexp_extract_all("_seq", every, F.lit(1))
    if canonical:
        back = F.reverse(F.regexp_extract_all(A.reverse_complement(F.col("_seq")), every, F.lit(1)))
        words = F.zip_with(words, back, lambda x, y: F.least(x, y))
    out = rows.select("seq_id", *keep, "_chunk", F.posexplode(words).alias("_pos", "kmer"))
    return out.select("seq_id", *keep, (F.col("_chunk") * CHUNK + F.col("_pos") + begin).alias("pos"), "kmer")


def bases(seqs: DataFrame) -> DataFrame:
    """(seq_id, pos, base, back): every base of each sequence, and the one as far from its end.

    Long sequences are cut into chunks, each with the mirrored part of the sequence.
    """
    raw, n = F.encode("seq", "UTF-8"), F.length("seq")
    chunks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(CHUNK)), lambda p: F.struct(
        F.substring(raw, p + 1, F.lit(CHUNK)).cast("string").alias("f"),
        F.reverse(F.substring(raw, F.greatest(n - p - CHUNK, F.lit(0)) + 1, F.least(n - p, F.lit(CHUNK))).cast("string")).alias("b"),
    ))
    rows = spread(seqs.select("seq_id", "seq")).filter(n > 0).select("seq_id", F.posexplode(chunks).alias("_chunk", "_part"))
    letters = lambda s: F.regexp_extract_all(s, F.lit("(.)"), F.lit(1))
    out = rows.select("seq_id", "_chunk", F.posexplode(F.arrays_zip(letters(F.col("_part.f")).alias("base"), letters(F.col("_part.b")).alias("back"))).alias("_pos", "_at"))
    return out.select("seq_id", (F.col("_chunk") * CHUNK + F.col("_pos")).alias("pos"), F.col("_at.base").alias("base"), F.col("_at.back").alias("back"))


def kmer_range(seqs: DataFrame, k: int, begin: int, end: int, canonical: bool = False) -> DataFrame:
    """k-mers that lie fully in [begin, end); ``begin`` must be below ``end``."""
    if begin >= end:
        raise ValueError("begin must be below end")
    return kmers(seqs, k, canonical, begin, end)


def kmer_weights(seqs: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(seq_id, kmer, weight): how often each sequence has each k-mer."""
    return kmers(seqs, k, canonical).groupBy("seq_id", "kmer").agg(F.count("*").alias("weight"))


def kmer_total(seqs: DataFrame, k: int) -> DataFrame:
    """Number of k-mers over all sequences, without making any."""
    return seqs.agg(F.coalesce(F.sum(F.greatest(F.length("seq") - k + 1, F.lit(0))), F.lit(0)).cast("long").alias("n_kmers"))


def weight_map(weights: DataFrame) -> DataFrame:
    """(seq_id, weights): one map for each sequence."""
    return weights.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("kmer", "weight"))).alias("weights"))


def map_to_rows(maps: DataFrame) -> DataFrame:
    return maps.select("seq_id", F.explode("weights").alias("kmer", "weight"))


def blocks(seqs: DataFrame, k: int, block: int, canonical: bool = True) -> DataFrame:
    """k-mers with the tumbling block that their start falls in."""
    return kmers(seqs, k, canonical).withColumn("block_no", F.floor(F.col("pos") / block).cast("int"))


def block_numbers(seqs: DataFrame, block: int) -> DataFrame:
    """Number of blocks of each sequence, trailing ones without k-mers included."""
    return seqs.select("seq_id", F.ceil(F.length("seq") / block).cast("int").alias("n_blocks"))


def slices(seqs: DataFrame, window: int, overlap: int, exclude_last: bool = True) -> DataFrame:
    """(seq_id, slicepos, beg, end, seq): hopping windows from each multiple of window - overlap.

    With ``exclude_last`` a window stops before the last base of the sequence.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and below window")
    n = F.length("seq")
    last = n - 1 if exclude_last else n
    rows = seqs.filter(n > 0).select("seq_id", "seq", F.explode(F.sequence(F.lit(0), n - 1, F.lit(window - overlap))).alias("beg"))
    rows = rows.withColumn("end", F.least(F.col("beg") + window, last)).filter("beg < end")
    return rows.select("seq_id", (F.col("beg") / (window - overlap)).cast("int").alias("slicepos"), "beg", "end", "seq")


def slice_kmers(seqs: DataFrame, k: int, window: int, overlap: int, canonical: bool = True, exclude_last: bool = True) -> DataFrame:
    """k-mers of each slice; slices shorter than k give no rows."""
    own = slices(seqs, window, overlap, exclude_last)
    part = own.select("seq_id", "slicepos", F.col("seq").substr(F.col("beg") + 1, F.col("end") - F.col("beg")).alias("seq"))
    return kmers(part, k, canonical, keep=("slicepos",))


def return_times(positions: DataFrame) -> DataFrame:
    """(seq_id, kmer, pos, gap): distance to the same k-mer's last occurrence in the sequence."""
    from pyspark.sql import Window as W

    w = W.partitionBy("seq_id", "kmer").orderBy("pos")
    return positions.withColumn("gap", F.col("pos") - F.lag("pos").over(w)).filter("gap IS NOT NULL")


def rolling_nthash(seqs: DataFrame, k: int) -> DataFrame:
    """(seq_id, pos, forward, reverse): ntHash of every k-mer, in time that does not depend on ``k``.

    A rolling hash turns by one bit at each base.  Turned back by their places, the bases' seeds no longer
    depend on the window, so each window is the difference of two running xors, turned forward again.
    """
    turns = np.arange(64, dtype=np.uint64)

    def turned(seeds: np.ndarray, by: np.ndarray) -> np.ndarray:
        by = by.astype(np.uint64) % np.uint64(64)
        return (seeds << by) | np.where(by == 0, np.uint64(0), seeds >> ((np.uint64(64) - by) % np.uint64(64)))

    own, other = np.zeros((256, 64), np.uint64), np.zeros((256, 64), np.uint64)
    for base, mate in zip("ACGT", "TGCA", strict=True):
        # By place: a base's seed turned back by it, and its mate's turned forward.
        own[ord(base)] = turned(np.full(64, NT_SEEDS[base], np.uint64), np.uint64(64) - turns)
        other[ord(base)] = turned(np.full(64, NT_SEEDS[mate], np.uint64), turns)

    def windows(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        place = np.arange(len(x)) % 64
        runs = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(table[x, place])])
        return runs[k:] ^ runs[:-k]

    def run(batches):
        for b in batches:
            for i, s in enumerate(b.column(1).to_pylist()):
                x = np.frombuffer((s or "").encode("ascii", "replace"), np.uint8)
                n = len(x) - k + 1
                if n <= 0:
                    continue
                at = np.arange(n)
                f = turned(windows(x, own), at + k - 1).view(np.int64)
                r = turned(windows(x, other), 64 - at % 64).view(np.int64)
                for lo in range(0, n, ROLL_ROWS):
                    part = slice(lo, lo + ROLL_ROWS)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(at[part]))), pa.array(at[part].astype(np.int32)), pa.array(f[part]), pa.array(r[part])], names=["seq_id", "pos", "forward", "reverse"])

    kind = seqs.schema["seq_id"].dataType.simpleString()
    return spread(seqs.select("seq_id", "seq")).mapInArrow(run, f"seq_id {kind}, pos int, forward long, reverse long")
