"""FASTA and FASTQ files as a DataFrame.

``read_fastx`` reads by Spark's text source, so one large plain file is read by many tasks; compressed files
are one task each.  ``FastxDataSource`` offers the same
records as ``spark.read.format("fastx")`` for files that Python can open.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, idx long, name string, seq string, qual string"


def parse_fastx(lines: Iterable[str]) -> Iterator[tuple[str, str, str | None]]:
    """(name, seq, qual) of each record; a FASTQ record has four lines, a FASTA sequence any number.

    Blank lines between records are skipped.  A record cut short, or a quality of another length than its
    sequence, is an error.
    """
    it = iter(lines)
    name, parts = None, []
    for line in it:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if name is not None:
                yield name, "".join(parts), None
            name, parts = line[1:], []
        elif name is not None:
            parts.append(line.strip())
        elif line.startswith("@"):
            try:
                seq, plus, qual = (next(it).rstrip("\r\n") for _ in range(3))
            except (StopIteration, RuntimeError):
                raise ValueError(f"record {line[1:]!r} is cut short") from None
            if not plus.startswith("+") or len(qual) != len(seq):
                raise ValueError(f"record {line[1:]!r} is malformed")
            yield line[1:], seq, qual
        elif line.strip():
            raise ValueError(f"unexpected line {line[:40]!r}")
    if name is not None:
        yield name, "".join(parts), None


class FastxPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        names = sorted(os.path.join(self.path, f) for f in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        return [FastxPartition(f) for f in names if not os.path.basename(f).startswith((".", "_"))]

    def read(self, partition):
        opener = gzip.open if partition.path.endswith(".gz") else open
        with opener(partition.path, "rt", encoding="ascii", errors="replace") as f:
            for idx, (name, seq, qual) in enumerate(parse_fastx(f)):
                yield partition.path, idx, name, seq, qual


class FastxDataSource(DataSource):
    """``spark.dataSource.register(FastxDataSource)``, then ``spark.read.format("fastx").load(path)``."""

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastxReader(self.options["path"])


def read_fastx(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, name, seq, qual) of FASTA or FASTQ files in any store that Spark reads; .gz is unpacked.

    FASTA is cut at ">" at the start of a line.  A FASTQ record is four lines, as "@" may also begin a
    quality line: lines are numbered within their file from one row of totals for each input split, so a
    large plain file is read by many tasks.  Blank lines may only end a file; a malformed record fails.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    if first[0][0].startswith(">"):
        raw = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.input_file_name())
        raw = raw.withColumn("at", F.monotonically_increasing_id())
        text = F.regexp_replace("value", "^>", "")
        rows = raw.filter(F.trim("value") != "").select("file", "at", F.regexp_extract(text, r"^([^\r\n]*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"), F.lit(None).cast("string").alias("qual"))
    else:
        rows = _fastq(spark.read.text(path))
    return rows.select("file", F.col("at").alias("idx"), "name", "seq", "qual")


def _fastq(text: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    lines = text.select(F.rtrim("value").alias("value"), F.input_file_name().alias("file"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # a row for each split
    splits = splits.select("file", "split", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = lines.join(splits, ["file", "split"]).withColumn("line", F.col("before") + F.col("id") - F.col("least"))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    found = numbered.groupBy("file", F.floor(F.col("line") / 4).alias("at")).agg(*[part(k).alias(f"l{k}") for k in range(4)])
    found = found.filter(F.greatest(*[F.length(F.coalesce(f"l{k}", F.lit(""))) for k in range(4)]) > 0)
    good = F.col("l0").startswith("@") & F.col("l2").startswith("+") & (F.length("l1") == F.length("l3"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("l1")).otherwise(F.raise_error(F.concat(F.lit("malformed record in "), "file")))
    return found.select("file", "at", F.substring("l0", 2, 1 << 30).alias("name"), checked.alias("seq"), F.col("l3").alias("qual"))


def retained(reads: DataFrame) -> DataFrame:
    """(seq_id, seq, qual): reads of bases only, numbered from 0 in the order of file and place."""
    from ..functions import alphabet as A
    from ..operators.ranks import running

    good = reads.filter(~F.col("seq").rlike("[^ACGTacgt]")).withColumn("_key", F.struct("file", "idx"))
    return running(good, "_key").select(F.col("row_index").alias("seq_id"), A.ascii_upper(F.col("seq")).alias("seq"), "qual")
