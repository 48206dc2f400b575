"""k-mer counts of a growing folder of reads.

The state is one row for each distinct k-mer; new files add to it batch by batch.  The checkpoint folder
makes the counts survive restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A
from ..operators.kmers import kmers


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Stream of sequences(seq) from Parquet files with a ``text`` column that appear in a folder."""
    schema = "doc_id long, text string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.select(F.col("doc_id").alias("seq_id"), A.keep_acgt(F.col("text")).alias("seq"))


def streaming_counts(seqs: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """(kmer, cnt) so far; write it in update or complete mode."""
    return kmers(seqs, k, canonical).groupBy("kmer").agg(F.count("*").alias("cnt"))
