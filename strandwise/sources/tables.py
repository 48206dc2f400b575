"""Sequences from the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet as A


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dna(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequences(seq_id, seq): the A, C, G, T of each text, in upper case; null stays null."""
    return docs.select(F.col(id_col).alias("seq_id"), A.keep_acgt(F.col(text_col)).alias("seq"))


def amino_acids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The 20 amino-acid letters of each text after upper-casing a-z."""
    return docs.select(F.col(id_col).alias("seq_id"), A.keep_amino_acids(A.ascii_upper(F.col(text_col))).alias("seq"))


def qualities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """qual(seq_id, qual): the printable ASCII characters of each text, read as quality codes."""
    return docs.select(F.col(id_col).alias("seq_id"), F.regexp_replace(F.col(text_col), "[^ -~]", "").alias("qual"))


def valid_reads(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Reads without any other character than A, C, G, T in either case; the rest is dropped whole."""
    return reads.filter(F.col(seq_col).isNotNull() & ~F.col(seq_col).rlike("[^ACGTacgt]")).withColumn(seq_col, A.ascii_upper(F.col(seq_col)))
