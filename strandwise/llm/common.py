"""Helpers shared by the operators: durable cuts of lineage and distributed ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: One word: a maximal run of bytes other than space, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where the session names none, as in tests, a local folder is made and set; on a cluster that is an
    error, as every machine would write to its own disk and what is read back would not be whole.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        known = "file://" + tempfile.mkdtemp(prefix="strandwise-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/strandwise/{what}-{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Remove all that these operators have written to the shared folder; for the end of a job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandwise")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[str], sums: dict[str, str], what: str = "ranked") -> DataFrame:
    """Add running totals in a global order without ever sorting in one task.

    ``sums`` maps a new column to the column that it totals over all rows *before* the row; the new
    column ``row_index`` counts those rows.  Rows are range-partitioned on ``order``; each partition
    runs its own window and is shifted by the totals of the partitions before it (one row each).
    """
    df = df.drop("row_index")
    held = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), what)
    inner = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    by_part = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    parts = held.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    parts = parts.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(by_part), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(by_part), F.lit(0)).alias(f"_t_{k}") for k in sums],
    )
    out = held.join(parts, F.col("_part") == F.col("_p"))
    shifted = {k: (F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_t_{k}")).cast("long") for k, c in sums.items()}
    shifted["row_index"] = (F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1 + F.col("_n")).cast("long")
    return out.select(*df.columns, *[v.alias(k) for k, v in shifted.items()])


#: Keys that hold more than one in this many rows are joined by broadcast: there are fewer of them than this.
HEAVY = 500


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and the number of its rows as ``weight``.

    Keys with more than n / ``HEAVY`` of the ``n`` rows, fewer than ``HEAVY``, are broadcast, so that their
    rows stay spread; all others are joined as Spark sees fit, and none of them is large.
    """
    table = table.withColumnRenamed(key, "_key")
    most = F.lit(max(1, n // HEAVY))
    heavy, light = table.filter(F.col(weight) > most), table.filter(F.col(weight) <= most)
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_key"))
    rest = rows.join(F.broadcast(heavy.select("_key")), F.col(key) == F.col("_key"), "left_anti")
    return out.union(rest.join(light, F.col(key) == F.col("_key"))).drop("_key", weight)


def slices(batches, rows: int = 400):
    """Arrow batches a few rows at a time, so that a worker holds the Python objects of few texts at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def beside_rows(docs: DataFrame, text_col: str, kinds: str, make, carry: list[str] | None = None) -> DataFrame:
    """(_row, new columns): the columns ``carry`` of every row (all, if not named) as a struct beside values from its text.

    ``make()`` is called once in a worker and gives a function from a list of texts (null: None) to one Arrow
    array for each column of the DDL ``kinds``.  Nothing is shuffled, and whatever the columns of ``docs`` are
    called, they don't meet the new ones.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.types import StructType

    rows = docs.select(F.struct("*").alias("_row"))
    if carry is not None:
        rows = docs.select(F.struct(*carry).alias("_row"), F.col(text_col).cast("string").alias("_text"))
    out = StructType([rows.schema["_row"], *StructType.fromDDL(kinds).fields])
    at = docs.columns.index(text_col)

    def run(batches):
        judge = make()
        for b in slices(batches):
            texts = pc.struct_field(b.column(0), [at]).cast(pa.string()) if carry is None else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), *judge(texts.to_pylist())], names=out.names)

    return rows.mapInArrow(run, out)


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo ``mod``: the fold of a document (a null id is in fold 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, text, y) of about ``bound`` labelled documents outside the held-out fold, or all if there are fewer.

    An id is in the sample if a hash of it is below bound / number of such ids: the same each time and evenly
    spread.  Null labels and null ids are left out; of several labels of one id the largest counts, and of
    several documents under one id the one whose text has the least hash, so rows are bounded as ids are.
    The ids are at most a little over ``bound``, so they are broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
    picked = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    n = picked.count()
    if n > bound:
        picked = picked.filter(F.shiftrightunsigned(F.xxhash64(F.lit(label), "doc_id"), 11) < F.lit(int(bound / n * (1 << 53))))
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
