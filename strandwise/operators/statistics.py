"""Read statistics: base composition, read lengths, load totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alphabet as A
from .ranks import running


def base_distribution(seqs: DataFrame) -> DataFrame:
    """(percent, base, frac): share of the reads in which a base makes up so many percent, rounded; all 101 x 4 rows."""
    reads = seqs.filter(F.length("seq") > 0)
    stacked = reads.select(F.length("seq").alias("n"), F.explode(F.array(*[F.struct(F.lit(b).alias("base"), A.base_count(F.col("seq"), b).alias("c")) for b in "ACGT"])).alias("x"))
    percent = F.floor(100 * F.col("x.c") / F.col("n") + 0.5).cast("int")
    counted = stacked.groupBy(F.col("x.base").alias("base"), percent.alias("percent")).agg(F.count("*").alias("c"))
    spark = seqs.sparkSession
    # The grid and the total have 404 rows and one row.
    grid = spark.range(101).select(F.col("id").cast("int").alias("percent"), F.explode(F.array(*[F.lit(b) for b in "ACGT"])).alias("base"))
    total = reads.agg(F.count("*").alias("n"))
    joined = F.broadcast(grid).join(counted, ["percent", "base"], "left").crossJoin(F.broadcast(total))
    return joined.select("percent", "base", F.when(F.col("n") > 0, F.coalesce("c", F.lit(0)) / F.col("n")).otherwise(F.lit(0.0)).alias("frac"))


def read_lengths(seqs: DataFrame) -> DataFrame:
    """(len, n): how many reads have each length."""
    return seqs.filter("seq IS NOT NULL").groupBy(F.length("seq").alias("len")).agg(F.count("*").alias("n"))


def read_length_quantiles(seqs: DataFrame, per_slot: int = 100) -> DataFrame:
    """(slot, quantile, len): lengths at i / slots for i up to the number of slots, one slot for ``per_slot`` reads.

    Made from the length histogram, so the window sees one row for each distinct length.
    """
    from pyspark.sql import Window as W

    hist = read_lengths(seqs)
    run = hist.withColumn("upto", F.sum("n").over(W.orderBy("len").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.partitionBy()))
    slots = F.floor(F.col("total") / per_slot)
    # A length answers for slot i if it is the first whose running count reaches i * total / slots.
    first = F.when(F.col("upto") == F.col("n"), F.lit(0)).otherwise(F.floor((F.col("upto") - F.col("n")) * slots / F.col("total")) + 1)
    last = F.floor(F.col("upto") * slots / F.col("total"))
    rows = run.filter(slots > 0).select("len", slots.alias("slots"), F.explode(F.when(last >= first, F.sequence(first, last))).alias("slot"))
    return rows.select(F.col("slot").cast("int").alias("slot"), (F.col("slot") / F.col("slots")).alias("quantile"), "len")


def load_totals(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """(n_reads, n_bases, bad_bases, bad_reads) of raw reads, before any is dropped."""
    bad = A.count_non_acgt(F.col(seq_col))
    return reads.agg(F.count(seq_col).alias("n_reads"), F.coalesce(F.sum(F.length(seq_col)), F.lit(0)).cast("long").alias("n_bases"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("bad_bases"), F.coalesce(F.sum((bad > 0).cast("long")), F.lit(0)).alias("bad_reads"))


def out_of_range(reads: DataFrame, longest: int, seq_col: str = "seq") -> DataFrame:
    """(non_acgt, too_long): characters other than bases, and reads over ``longest``."""
    return reads.agg(F.coalesce(F.sum(A.count_non_acgt(F.col(seq_col))), F.lit(0)).cast("long").alias("non_acgt"), F.coalesce(F.sum((F.length(seq_col) > longest).cast("long")), F.lit(0)).alias("too_long"))


def base_counts(seqs: DataFrame) -> DataFrame:
    """(seq_id, n_a, n_c, n_g, n_t, n_other)."""
    s = F.col("seq")
    counts = {f"n_{b.lower()}": A.base_count(s, b) for b in "ACGT"}
    other = F.length(s).cast("long") - sum(counts.values(), F.lit(0).cast("long"))
    return seqs.select("seq_id", *[c.alias(n) for n, c in counts.items()], other.alias("n_other"))


def equal_groups(sizes: DataFrame, groups: int, order_col: str = "i", size_col: str = "size") -> DataFrame:
    """(group_no, frontier): contiguous groups of near-equal total, each ended by an exclusive frontier.

    With step = round(total / groups), an item whose running total passes (number of closed groups + 1) *
    step closes a group, one at most; it belongs to that group if the excess is at most the shortfall.
    The number of closed groups after item i has a closed form, i + min(1, least of needed_j - j so far)
    with needed_j the steps below j's running total, so it is a running minimum and not a fold.
    """
    total = sizes.agg(F.sum(size_col).alias("_total"), F.count("*").alias("_items"))
    run = running(sizes, order_col, {"_before": size_col}).crossJoin(F.broadcast(total))  # one row
    step = F.greatest(F.floor(F.col("_total") / groups + 0.5), F.lit(1))
    run = run.withColumn("_step", step).withColumn("_upto", F.col("_before") + F.col(size_col))
    run = run.withColumn("_lead", F.greatest(F.ceil(F.col("_upto") / F.col("_step")) - 1, F.lit(0)) - F.col("row_index"))
    run = running(run.withColumnRenamed("row_index", "_i"), "_i", mins={"_least": "_lead"})
    closed = F.col("_i") + F.least(F.lit(1), F.col("_least"))
    # A group is closed by the first item at which the number is reached.
    run = run.withColumn("_closed", closed)
    first = run.filter("_closed > 0").groupBy("_closed", "_step", "_items").agg(F.min(F.struct("_i", "_before", "_upto")).alias("x"))
    goal = F.col("_closed") * F.col("_step")
    frontier = F.col("x._i") + F.when(F.col("x._upto") - goal <= goal - F.col("x._before"), 1).otherwise(0)
    cuts = first.select((F.col("_closed") - 1).cast("int").alias("group_no"), frontier.cast("long").alias("frontier"), F.col("_items"))
    last = total.select(F.col("_items").cast("long").alias("frontier"))
    most = cuts.agg(F.coalesce(F.max("group_no"), F.lit(-1)).alias("g"), F.coalesce(F.max("frontier"), F.lit(0)).alias("f"))
    rest = last.crossJoin(F.broadcast(most)).filter("f < frontier").select((F.col("g") + 1).cast("int").alias("group_no"), "frontier")
    return cuts.select("group_no", "frontier").union(rest)
