"""Small helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesheaf.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    This cuts the lineage: a lost executor costs no recomputation of what was written, and Spark knows
    the size of what it reads, so that it broadcasts such a table only below its own threshold.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of one Arrow batch. Spark's 10,000 whole texts are some 40 MB, which a task holds several times in the JVM and in Python.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most ``BATCH_ROWS`` rows to Python at once; a smaller number that is set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def fold_of(column: str, modulus: int) -> Column:
    """Remainder of CRC-32 of an id written as text; null ids take part as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


# Distinct groups that a bounded sample is drawn from, the most frequent ones.
GROUPS = 1000


def drawn_rows(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """A bounded sample: the ``n`` rows of each group with the smallest ``order``, a 64-bit hash of the row.

    Groups are counted first, so that some four times ``n`` rows of a group are ranked, not ``n`` of every task of the
    scan. Groups beyond the ``GROUPS`` most frequent give nothing.
    """
    counts = df.groupBy(group).count().orderBy(F.desc("count"), group).limit(GROUPS)
    share = F.broadcast(counts.select(F.col(group).alias("_of"), (4.0 * n / F.col("count")).alias("_share")))
    low = df.join(share, F.col(group) == F.col("_of")).where(F.col(order) / F.lit(2.0**64) + 0.5 <= F.col("_share"))
    w = Window.partitionBy(group).orderBy(order)
    return low.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank", "_of", "_share")
