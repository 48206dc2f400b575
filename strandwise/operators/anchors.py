"""Anchors: bottom-k sketches of hopping slices, and the index from minimum hash to slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kmers import slice_kmers
from .sketch import bottom_k, code_hash, slice_sketch


def slice_anchors(seqs: DataFrame, k: int, window: int, overlap: int, size: int, hash_fn: Callable[[Column], Column] = code_hash, exclude_last: bool = True) -> DataFrame:
    """(seq_id, slicepos, rank, hash, cnt)."""
    made = slice_sketch(seqs, k, window, overlap, size, hash_fn, exclude_last)
    if made is not None:
        return made
    rows = slice_kmers(seqs, k, window, overlap, True, exclude_last)
    return bottom_k(rows, size, hash_fn(F.col("kmer")), ("seq_id", "slicepos"))


def anchor_arrays(anchors: DataFrame) -> DataFrame:
    """(seq_id, slicepos, anchors): one array of (hash, cnt) in order of hash for each slice."""
    return anchors.groupBy("seq_id", "slicepos").agg(F.array_sort(F.collect_list(F.struct("hash", "cnt"))).alias("anchors"))


def anchor_index(anchors: DataFrame) -> DataFrame:
    """(hash, seq_id, slicepos): minimum hash of a slice to the slice; of several the last in order stays."""
    firsts = anchors.filter("rank = 1")
    return firsts.groupBy("hash").agg(F.max(F.struct("seq_id", "slicepos")).alias("x")).select("hash", "x.seq_id", "x.slicepos")


def read_anchor_counts(anchors: DataFrame) -> DataFrame:
    """(seq_id, n_slices, n_anchors)."""
    return anchors.groupBy("seq_id").agg(F.countDistinct("slicepos").alias("n_slices"), F.count("*").alias("n_anchors"))


def key_text(file: str, process: str, window: int, k: int) -> Column:
    """Key of a slice in a key-value store: fields joined by colons."""
    return F.concat_ws(":", F.lit(file), F.lit(process), F.lit(str(window)), F.lit(str(k)), F.col("seq_id").cast("string"), F.col("slicepos").cast("string"))


def value_text(anchors: Column) -> Column:
    """Value of a slice: hash,count pairs joined by colons."""
    return F.array_join(F.transform(anchors, lambda x: F.concat_ws(",", x["hash"].cast("string"), x["cnt"].cast("string"))), ":")


def value_from_text(text: Column) -> Column:
    """Back from ``value_text`` to the array of (hash, cnt)."""
    fields = F.filter(F.split(text, ":"), lambda x: x != "")
    return F.transform(fields, lambda x: F.struct(F.split(x, ",")[0].cast("long").alias("hash"), F.split(x, ",")[1].cast("long").alias("cnt")))
