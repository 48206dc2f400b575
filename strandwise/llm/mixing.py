"""Mixing sources to target weights.

Words are totalled per source; each source's target divided by its total is its repetition rate, and
every document is taken floor(rate) times plus once more with probability equal to the fraction: one Bernoulli
copy, decided by an md5 of seed, id and occurrence, so that a rerun takes the same copies.  The words that a
source takes so have its target as their mean; the spread is that of independent draws.

Sources are ordered by code point with the null source last and weigh ``weights`` in turn.  Together they
get ``share`` of all words; a target stops at ``limit`` times its source's words and what is over goes to
the others by weight, again and again until no target is above its limit.

Rows that repeat an id, or whose id is null, draw independently: the coin of a row holds a digest of its
text, and rows equal in id, source and text are numbered from 0 (which of them has which number doesn't change
the mix of these columns).  Null and empty texts have size 0 and are still taken by their source's rate;
a text of any length is counted whole.  A source without words has target 0 and rate 0.  An empty table gives an
empty result.  Rows keep all their columns; other columns are not read, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, ranked

SEED = 20240531


def n_words(text_col: str = "text"):
    """Number of words of a text, 0 for null, on the JVM."""
    gaps = F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), WORD, "x")
    return F.length(F.translate(gaps, " \t\n\x0b\x0c\r", "")).cast("long")


def _coin(seed: int, id_col: str, digest_col: str, occurrence_col: str):
    """A 32-bit fraction of a row's id, text digest and occurrence."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest_col, F.col(occurrence_col).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _copies(coin, target: str, size: str):
    """floor(rate), and one more if the coin is below the rest."""
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    return (F.floor(rate) + (coin < rate - F.floor(rate)).cast("int")).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With every target min(weight * level, limit * size), the level follows from running totals over the
    sources ordered by limit * size / weight: those before some place are at their limit and the rest
    divide what is left by weight.  Both orders are range-partitioned, so any number of sources will do.
    """
    named = totals.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1))
    named = ranked(named, ["_null", "source"], {"_i": "_one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    named = named.withColumn("_w", weight.cast("long")).withColumn("_full", F.col("source_size") / F.col("_w"))
    named = cut(ranked(named, ["_full", "_i"], {"_w_before": "_w", "_size_before": "source_size"}, "levels"), "levels")
    whole = named.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_all_w"))
    # The level if exactly the sources before this one were at their limit; the first place where it fits holds.
    left = F.col("_all") * F.lit(share) - F.col("_size_before") * F.lit(limit)
    level = left / (F.col("_all_w") - F.col("_w_before"))
    levels = named.crossJoin(F.broadcast(whole))  # one row
    at = levels.filter(level <= F.col("_full") * F.lit(limit)).agg(F.min_by(level, "row_index").alias("_level"))
    return named.crossJoin(F.broadcast(at)).select(
        "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("_w") * F.coalesce("_level", F.lit(float("inf"))), F.col("source_size") * F.lit(limit))).cast("double").alias("target"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (written, with ``_key`` and ``_part``) with ``_occurrence``: 0, 1, ... among rows of one key.

    Rows are numbered within (keys, part) and shifted by the counts of the parts before, so that no task
    gathers a group that spreads over many parts.  Only keys that occur more than once are shuffled.
    """
    same = rows.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_key").orderBy("_part")
    parts = same.select("_key", "_part", F.sum("_n").over(before).alias("_upto"), "_n", F.sum("_n").over(W.partitionBy("_key")).alias("_all"))
    parts = cut(parts.filter("_all > 1").select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), (F.col("_upto") - F.col("_n")).alias("_offset")), "repeated")
    met = (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_p"))
    again = rows.join(parts, met)
    own = W.partitionBy("_key", "_part").orderBy(F.lit(0))
    again = again.withColumn("_occurrence", F.row_number().over(own) - 1 + F.col("_offset")).select(*rows.columns, "_occurrence")
    return rows.join(parts, met, "left_anti").withColumn("_occurrence", F.lit(0).cast("long")).union(again)


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: list, **how) -> DataFrame:
    """Rows (``keep``, doc_id, source, size, source_size, target, copies)."""
    digest = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    source = F.col(source_col).cast("string")
    held = docs.select(*keep, F.col(id_col).alias("_id"), source.alias("_own"), n_words(text_col).alias("_size"), digest.alias("_digest"))
    held = held.withColumn("_key", F.struct(F.xxhash64("_id", "_own", "_digest").alias("a"), F.xxhash64(F.lit(1), "_id", "_own", "_digest").alias("b")))
    held = cut(held.withColumn("_part", F.spark_partition_id()), "sizes")
    totals = held.groupBy(F.col("_own").alias("source")).agg(F.sum("_size").alias("source_size"))
    plan = cut(source_targets(totals, **how), "targets")
    rows = numbered(held).join(plan, F.col("_own").eqNullSafe(F.col("source")))
    return rows.withColumn("copies", _copies(_coin(seed, "_id", "_digest", "_occurrence"), "target", "source_size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row: ``copies`` is how often the mix takes it."""
    return _drawn(docs, id_col, text_col, source_col, seed, [], **how).select(F.col("_id").alias("doc_id"), "source", F.col("_size").alias("size"), "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    taken = _drawn(docs, id_col, text_col, source_col, seed, [F.struct("*").alias("_row")], **how)
    return taken.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
