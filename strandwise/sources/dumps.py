"""Tables of counts, unique k-mers, signatures, anchors and statistics as files, and back.

Parquet is the format; parameters lie beside it as JSON in a one-row text file.  Binary layouts exist for
exchange with other tools (little-endian, see the constants): repeated and once-seen k-mers of both
alphabets, signatures and block signatures.  Tasks write them as files of their own; they are read as ``binaryFile``.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketch import SketchParams, code_words, word_codes

#: First four bytes of the binary layouts (fixed values).
MAGIC_MULTI, MAGIC_ONCE, MAGIC_SIG, MAGIC_BLOCKS = 0xCEA2BBFF, 0xCEA2BBDD, 0xCEABEADD, 0xCEABBADD


def write_counts(counts: DataFrame, path: str, least: int = 2) -> None:
    """Counts of at least ``least``, in parallel by partition."""
    counts.filter(F.col("cnt") >= least).write.mode("overwrite").parquet(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_unique(unique: DataFrame, path: str) -> None:
    unique.select("kmer", "seq_id", "pos").write.mode("overwrite").parquet(path)


def write_signatures(sigs: DataFrame, params: SketchParams, path: str, by: list[str] | None = None) -> None:
    """Signatures under ``path``/sig and their parameters under ``path``/params."""
    writer = sigs.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/sig")
    write_params(sigs.sparkSession, params, f"{path}/params")


def read_signatures(spark: SparkSession, path: str) -> tuple[DataFrame, SketchParams]:
    return spark.read.parquet(f"{path}/sig"), read_params(spark, f"{path}/params")


def write_params(spark: SparkSession, params: SketchParams, path: str) -> None:
    spark.createDataFrame([(params.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> SketchParams:
    return SketchParams.from_json(spark.read.text(path).first()[0])


def write_base_distribution(dist: DataFrame, path: str) -> None:
    """101 lines of four shares, A C G T, separated by blanks."""
    wide = dist.groupBy("percent").pivot("base", list("ACGT")).agg(F.first("frac"))
    wide.orderBy("percent").coalesce(1).select(*"ACGT").write.mode("overwrite").csv(path, sep=" ")  # 101 rows


def write_read_lengths(lengths: DataFrame, path: str) -> None:
    """Lines of length and count."""
    lengths.orderBy("len").select("len", "n").write.mode("overwrite").csv(path, sep=" ")


def write_key_values(anchors: DataFrame, index: DataFrame, path: str) -> None:
    """The two tables of a key-value store: slice to anchors, and minimum hash to slice."""
    anchors.write.mode("overwrite").parquet(f"{path}/anchors")
    index.write.mode("overwrite").parquet(f"{path}/anchor_index")


def write_edges(edges: DataFrame, path: str) -> None:
    """The neighbour graph."""
    edges.write.mode("overwrite").parquet(path)


# --- binary layouts --------------------------------------------------------------------------------------
#
# Each task makes files of at most PART_ROWS records from the rows that it has, so no task gathers a table.
# A dump is a table (part, data) of such files; ``write_files`` stores them one by one.

PART_ROWS = 1 << 20


def _kmer_fields(k: int, aa: bool) -> list[tuple[str, str]]:
    """Fields of a k-mer's record: a code of 4 bytes, or its length and a wider code."""
    if aa:
        return [("n", "u1"), ("code", "<u4")] if k <= 6 else [("n", "u1"), ("code", "<u8"), ("high", "<u8")]
    return [("code", "<u4")] if k <= 16 else [("n", "u1"), ("code", "<u8")]


def _kmer_records(words: list[str] | np.ndarray, k: int, aa: bool, *more: tuple[str, str, object]) -> np.ndarray:
    """Records of k-mers (texts, or codes as longs) and further fields (name, type, values), in order of the codes."""
    rec = np.zeros(len(words), np.dtype(_kmer_fields(k, aa) + [(n, t) for n, t, _ in more]))
    rec["code"] = words.view(np.uint64) if isinstance(words, np.ndarray) else word_codes(words, k, aa)
    if "n" in rec.dtype.names:
        rec["n"] = k
    for name, kind, values in more:
        if len(values) and np.max(values) > np.iinfo(np.dtype(kind)).max:
            raise ValueError(f"{name} is too large for the layout")
        rec[name] = values
    return rec[np.argsort(rec["code"])]


def _in_parts(rows: DataFrame, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """(part, data): what ``make`` gives for each PART_ROWS rows of each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held, n, made = TaskContext.get().partitionId(), [], 0, 0
        for pdf in batches:
            while len(pdf):
                held.append(pdf.iloc[: PART_ROWS - n])
                n, pdf = n + len(held[-1]), pdf.iloc[PART_ROWS - n :]
                if n == PART_ROWS:
                    yield pd.DataFrame({"part": [f"{task:06d}-{made:06d}"], "data": [make(pd.concat(held))]})
                    held, n, made = [], 0, made + 1
        if n:
            yield pd.DataFrame({"part": [f"{task:06d}-{made:06d}"], "data": [make(pd.concat(held))]})

    return rows.mapInPandas(run, "part string, data binary")


def write_files(dump: DataFrame, folder: str) -> int:
    """Store each part of a dump as the file ``folder``/part; the number of files.

    Executors write, by a path or URI that all of them share.  A file gets its name when it is complete, and a
    task that runs again replaces all its files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        for pdf in batches:
            for part, data in zip(pdf["part"], pdf["data"], strict=True):
                with store.open_output_stream(f"{root}/_{part}.{attempt}") as f:
                    f.write(data)
                store.move(f"{root}/_{part}.{attempt}", f"{root}/{part}")
                yield pd.DataFrame({"part": [part]})

    return dump.select("part", "data").mapInPandas(run, "part string").count()


def _from_files(files: DataFrame, content_col: str, take: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                yield take(data)

    return files.select(F.col(content_col).alias("content")).mapInPandas(run, schema)


def multi_to_binary(counts: DataFrame, k: int, data_type: str = "DNA") -> DataFrame:
    """(part, data): counts from 2 on as header, then (k-mer, 16-bit count); larger counts are kept as 65,535.

    k-mers are a column ``kmer`` of texts, or ``code`` of longs.
    """
    aa, coded = data_type == "AA", "code" in counts.columns

    def make(pdf: pd.DataFrame) -> bytes:
        rec = _kmer_records(pdf["code"].to_numpy(np.int64) if coded else pdf["kmer"].to_list(), k, aa, ("c", "<u2", pdf["cnt"].to_numpy()))
        return struct.pack("<IBBQ", MAGIC_MULTI, k, 2, len(rec)) + rec.tobytes()

    return _in_parts(counts.filter("cnt >= 2").select("code" if coded else "kmer", F.least("cnt", F.lit(65535)).alias("cnt")), make)


def multi_from_binary(files: DataFrame, content_col: str = "content", data_type: str = "DNA") -> DataFrame:
    """(kmer, cnt) of binary count dumps, such as ``spark.read.format("binaryFile")`` gives."""
    aa = data_type == "AA"

    def take(data: bytes) -> pd.DataFrame:
        magic, k, width, n = struct.unpack_from("<IBBQ", data)
        if magic != MAGIC_MULTI or width not in (1, 2):
            raise ValueError("not a dump of repeated k-mers")
        rec = np.frombuffer(data, np.dtype(_kmer_fields(k, aa) + [("c", f"<u{width}")]), n, 14)
        return pd.DataFrame({"kmer": code_words(rec["code"], k, aa), "cnt": rec["c"].astype(np.int64)})

    return _from_files(files, content_col, take, "kmer string, cnt long")


def unique_to_binary(unique: DataFrame, k: int, data_type: str = "DNA") -> DataFrame:
    """(part, data): once-seen k-mers as header, then (k-mer, sequence, place)."""
    aa = data_type == "AA"

    def make(pdf: pd.DataFrame) -> bytes:
        rec = _kmer_records(pdf["kmer"].to_list(), k, aa, ("seq", "<u4", pdf["seq_id"].to_numpy()), ("pos", "<u4", pdf["pos"].to_numpy()))
        return struct.pack("<IBQ", MAGIC_ONCE, k, len(rec)) + rec.tobytes()

    return _in_parts(unique.select("kmer", "seq_id", "pos"), make)


def unique_from_binary(files: DataFrame, content_col: str = "content", data_type: str = "DNA") -> DataFrame:
    """(kmer, seq_id, pos) of binary dumps of once-seen k-mers."""
    aa = data_type == "AA"

    def take(data: bytes) -> pd.DataFrame:
        magic, k, n = struct.unpack_from("<IBQ", data)
        if magic != MAGIC_ONCE:
            raise ValueError("not a dump of once-seen k-mers")
        rec = np.frombuffer(data, np.dtype(_kmer_fields(k, aa) + [("seq", "<u4"), ("pos", "<u4")]), n, 13)
        return pd.DataFrame({"kmer": code_words(rec["code"], k, aa), "seq_id": rec["seq"].astype(np.int64), "pos": rec["pos"].astype(np.int32)})

    return _from_files(files, content_col, take, "kmer string, seq_id long, pos int")


def _slots(pdf: pd.DataFrame) -> np.ndarray:
    a = np.stack(pdf["sig"].to_list()).astype(np.int64)
    if a.min() < 0 or a.max() > 0xFFFFFFFF:
        raise ValueError("the layout holds 32-bit values")
    return a.astype("<u4")


def signatures_to_binary(sigs: DataFrame, k: int) -> DataFrame:
    """(part, data): signatures of 32-bit values in order of seq_id, from part to part and within each."""

    def make(pdf: pd.DataFrame) -> bytes:
        a = _slots(pdf)
        return struct.pack("<IIII", MAGIC_SIG, 4, a.shape[1], k) + a.tobytes()

    return _in_parts(sigs.select("seq_id", "sig").repartitionByRange("seq_id").sortWithinPartitions("seq_id"), make)


def signatures_from_binary(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(idx, k, sig) of binary signature dumps; idx counts within a file."""

    def take(data: bytes) -> pd.DataFrame:
        magic, width, m, k = struct.unpack_from("<IIII", data)
        if magic != MAGIC_SIG or width != 4:
            raise ValueError("not a dump of signatures")
        a = np.frombuffer(data, "<u4", offset=16).reshape(-1, m).astype(np.int64)
        return pd.DataFrame({"idx": range(len(a)), "k": k, "sig": list(a)})

    return _from_files(files, content_col, take, "idx long, k int, sig array<long>")


def blocks_to_binary(blocks: DataFrame, k: int, block: int) -> DataFrame:
    """(part, data): block signatures of 32-bit values as header, then for each run of blocks of one sequence its
    number and theirs, and each block's sequence, number and slots."""

    def make(pdf: pd.DataFrame) -> bytes:
        a = _slots(pdf)
        seq, no = pdf["seq_id"].to_numpy(), pdf["block_no"].to_numpy()
        if seq.min() < 0 or seq.max() > 0xFFFFFFFF:
            raise ValueError("seq_id is too large for the layout")
        rec = np.concatenate([np.stack([seq, no], 1).astype("<u4"), a], 1)
        at = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        runs = zip(at, np.r_[at[1:], len(seq)], strict=True)
        return struct.pack("<IBIII", MAGIC_BLOCKS, 4, a.shape[1], k, block) + b"".join(struct.pack("<II", seq[i], j - i) + rec[i:j].tobytes() for i, j in runs)

    rows = blocks.select("seq_id", "block_no", "sig")
    return _in_parts(rows.repartitionByRange("seq_id", "block_no").sortWithinPartitions("seq_id", "block_no"), make)


def blocks_from_binary(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(seq_id, block_no, k, block, sig) of binary dumps of block signatures."""

    def take(data: bytes) -> pd.DataFrame:
        magic, width, m, k, block = struct.unpack_from("<IBIII", data)
        if magic != MAGIC_BLOCKS or width != 4:
            raise ValueError("not a dump of block signatures")
        parts, at = [], 17
        while at < len(data):
            _, n = struct.unpack_from("<II", data, at)
            parts.append(np.frombuffer(data, "<u4", n * (m + 2), at + 8).reshape(n, m + 2))
            at += 8 + 4 * n * (m + 2)
        a = np.concatenate(parts).astype(np.int64)
        return pd.DataFrame({"seq_id": a[:, 0], "block_no": a[:, 1].astype(np.int32), "k": k, "block": block, "sig": list(a[:, 2:])})

    return _from_files(files, content_col, take, "seq_id long, block_no int, k int, block int, sig array<long>")
