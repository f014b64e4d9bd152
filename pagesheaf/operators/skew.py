"""Joins that survive one key holding a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(facts: DataFrame, key: str, parts: int) -> DataFrame:
    """Keys that hold at least one ``parts``-th of all rows, with the slices they need (``key, slices``).

    There are at most ``parts`` of them whatever the table holds, every other key fits into a slice of that size, and
    the slices of all hot keys together are at most twice ``parts``. Rows are counted with map-side combining.
    """
    total = facts.agg(F.count("*")).scalar()
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") * parts >= total).select(key, F.ceil(F.col("n") * parts / total).cast("int").alias("slices"))


def skew_safe_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "inner",
    parts: int | None = None,
) -> DataFrame:
    """Join many ``facts`` to a ``lookup`` that is unique on ``key``.

    Facts of hot keys are spread over their slices by a hash of ``spread_by``, and only the lookup rows of hot keys are
    repeated, once per slice. Facts without a key never match and are spread as well. ``parts`` is four times the number of
    shuffle partitions unless given; the broadcast list of hot keys has at most so many rows. ``facts`` is read three
    times, so it should be a stored or otherwise cheap table of narrow rows.
    """
    if parts is None:
        parts = 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(facts, key, parts))
    spread = F.xxhash64(*spread_by)
    slice_no = F.when(F.col(key).isNull(), F.pmod(spread, F.lit(parts))).when(
        F.col("slices").isNotNull(), F.pmod(spread, F.col("slices"))
    ).otherwise(F.lit(0))
    left = facts.join(hot, key, "left").withColumn("slice", slice_no.cast("int"))
    right = lookup.join(hot, key, "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
    )
    return left.drop("slices").join(right.drop("slices"), [key, "slice"], how).drop("slice")


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; combined on the map side before any exchange."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min(F.struct(*order, *[c for c in others if c not in order])).alias("best"))
    return best.select(key, *[F.col(f"best.{c}").alias(c) for c in others])
