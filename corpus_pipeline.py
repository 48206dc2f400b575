"""The corpus pipeline: five operators in a row, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  ``run`` writes each stage's result to the shared folder and reads it back, so no stage
recomputes another and a lost executor costs a re-read.

Rows with null ids, null or empty texts, null languages or sources, very long texts and repeated rows go through
like any other: an empty text isn't toxic but fails the base rules, of equal rows one passes the near-copy stage,
ties are settled by the smallest id and then by the text's hash.  Extra columns are carried to the mix whatever
they are called.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm.common import cut, table
from strandwise.llm.mixing import mixed_documents
from strandwise.llm.outliers import kept_documents
from strandwise.llm.queries import tokenizer
from strandwise.llm.sentencepiece_codec import token_digests
from strandwise.llm.simhash import one_of_each
from strandwise.llm.toxicity import without_toxic

#: From this score on a document counts as toxic.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``, each row judged by its own text."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), TOXIC)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group's Mahalanobis bound, each by its own text."""
    return kept_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each copy."""
    return token_digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_dedup),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: The grammar, the determinant estimates and the tokenizer have no SQL form; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
