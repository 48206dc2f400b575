"""Exact k-mer counts over all sequences: the plain hash aggregate, combined before its one shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..functions.hashing import mix64
from .kmers import kmers, spread
from .sketch import batch_codes


def kmer_counts(seqs: DataFrame, k: int, canonical: bool = True, counter_bits: int | None = None) -> DataFrame:
    """(kmer, cnt); with ``counter_bits`` counts stop at the counter's largest value."""
    if not 1 <= k <= 32:
        raise ValueError("k must be from 1 to 32")
    out = kmers(seqs, k, canonical).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return saturated(out, counter_bits) if counter_bits else out


def saturated(counts: DataFrame, bits: int) -> DataFrame:
    return counts.withColumn("cnt", F.least("cnt", F.lit((1 << bits) - 1).cast("long")))


#: Sequences whose k-mers are summed before they leave a batch, and buckets that a batch's codes are dealt to.
SUMMED, BUCKETS = 1024, 1024


def code_counts(seqs: DataFrame, k: int, canonical: bool = True, aa: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """(code, cnt) of all k-mers as 64-bit codes.

    Codes are summed in each Arrow batch and shuffled as one packed row for each bucket of their hashes; a bucket is
    summed at once, so it should hold no more than a task's memory: with 1,024 buckets a thousandth of the codes.
    """
    if not 1 <= k <= (12 if aa else 31):
        raise ValueError("k is too large for a code of 64 bits")

    def packed(x: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), SUMMED):
                codes = batch_codes([s or "" for s in b.column(0).slice(at, SUMMED).to_pylist()], k, aa, canonical)[0]
                for part in range(0, len(codes), PACKED):
                    code, cnt = np.unique(codes[part : part + PACKED], return_counts=True)
                    bucket = (mix64(code) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    code, cnt, bucket = code[order], cnt[order].astype(np.int64), bucket[order]
                    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                    ends = np.r_[first, len(code)]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), packed(code, ends), packed(cnt, ends)], names=["bucket", "codes", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        code, cnt = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column(c)]) for c in ("codes", "counts"))
        order = np.argsort(code)
        code, cnt = code[order], cnt[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        return pa.table({"code": code[first], "cnt": np.add.reduceat(cnt, first)})

    rows = spread(seqs.select("seq_id", "seq")).select("seq").mapInArrow(pack, "bucket int, codes binary, counts binary")
    return rows.groupBy("bucket").applyInArrow(add, "code long, cnt long")


#: Codes of a packed batch, at most.
PACKED = 1 << 24


def partitioned_counts(seqs: DataFrame, k: int, parts: int) -> DataFrame:
    """Counts by an explicit number of counters, which are split further below ``BUCKETS`` of them."""
    return code_counts(seqs, k, buckets=parts * -(-BUCKETS // parts)).select(A.kmer_from_code(F.col("code"), k).alias("kmer"), "cnt")


def lookup(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(kmer, cnt) of each wanted k-mer, 0 if it was never seen."""
    return wanted.join(counts, "kmer", "left").select("kmer", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def above_two(counts: DataFrame) -> DataFrame:
    """Counts, with 0 for what was seen only once."""
    return counts.withColumn("cnt", F.when(F.col("cnt") >= 2, F.col("cnt")).otherwise(F.lit(0)).cast("long"))


def repeated(counts: DataFrame) -> DataFrame:
    """k-mers seen at least twice."""
    return counts.filter("cnt >= 2")


def summary(counts: DataFrame) -> DataFrame:
    """(n_distinct, n_unique, n_total, max_cnt) of a count table."""
    return counts.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum((F.col("cnt") == 1).cast("long")), F.lit(0)).alias("n_unique"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_total"), F.max("cnt").alias("max_cnt"))


def unique_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, seq_id, pos) of canonical k-mers seen exactly once in all."""
    once = kmers(seqs, k, True).groupBy("kmer").agg(F.count("*").alias("cnt"), F.min(F.struct("seq_id", "pos")).alias("at"))
    return once.filter("cnt = 1").select("kmer", "at.seq_id", "at.pos")


def present(positions: DataFrame, counts: DataFrame) -> DataFrame:
    """Occurrences whose k-mer is in the count table (left semi join)."""
    return positions.join(counts.select("kmer"), "kmer", "left_semi")


def absent(positions: DataFrame, counts: DataFrame) -> DataFrame:
    return positions.join(counts.select("kmer"), "kmer", "left_anti")


def first_occurrences(positions: DataFrame) -> DataFrame:
    """(kmer, seq_id, pos) of each k-mer's first occurrence."""
    return positions.groupBy("kmer").agg(F.min(F.struct("seq_id", "pos")).alias("at")).select("kmer", "at.seq_id", "at.pos")
