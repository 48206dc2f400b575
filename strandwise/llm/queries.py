"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import crc_mod, table
from .embedding_join import near_vectors
from .gam_classifier import quality_scores
from .mixing import mix
from .kneser_ney import held_out_scores
from .outliers import BASE, quality_verdicts
from .sentencepiece_codec import token_digests
from .sharding import shard_documents
from .simhash import simhash_components
from .token_counts import section_token_counts
from .toxicity import toxicity_scores

SHARDS = 24


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def op2_lm_scoring(spark, sf_dir):
    scored = held_out_scores(table(spark, sf_dir, "documents"))
    return scored.withColumn("held_out", crc_mod("doc_id", 7) == 2)


def op3_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return section_token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_rules(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


def op9_quality_classifier(spark, sf_dir):
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_sharding(spark, sf_dir):
    placed = shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_sentencepiece(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op10_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


#: The same water level and coins in SQL: sources are few there, so plain windows do.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS i FROM s
), o AS (
  SELECT *, source_size / w::DOUBLE AS f,
         coalesce(sum(w) OVER (ORDER BY source_size / w::DOUBLE, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb,
         coalesce(sum(source_size) OVER (ORDER BY source_size / w::DOUBLE, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
         row_number() OVER (ORDER BY source_size / w::DOUBLE, i) AS k,
         sum(source_size) OVER () AS a, sum(w) OVER () AS aw FROM n
), v AS (
  SELECT arg_min((a * 1.5::DOUBLE - sb * 2.0::DOUBLE) / (aw - wb), k) AS level FROM o WHERE (a * 1.5::DOUBLE - sb * 2.0::DOUBLE) / (aw - wb) <= f * 2
), t AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(w * level, source_size * 2.0::DOUBLE) END AS target FROM o, v
), r AS (
  SELECT doc_id, size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('20240531:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || (row_number() OVER (PARTITION BY doc_id, d.source, digest) - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (floor(rate) + (coin < rate - floor(rate))::INT)::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id),
l AS (SELECT a, b FROM c WHERE isfinite(s) AND s >= 0.95),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.root),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.node = v.vec_id
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_lm_scoring, op3_embedding_near_dedup, op4_token_counts, op5_quality_rules, op9_quality_classifier, op6_sharding, op7_mixing, op8_sentencepiece, op10_simhash)}
ORACLES = {"op3_embedding_near_dedup": OP3_SQL, "op7_mixing": OP7_SQL}
