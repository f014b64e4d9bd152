"""Decisions over repeated observations of one page.

Every decision looks at a limited number of rounds. Filtering on the round number first bounds each
page's group by that limit, however many snapshots of it are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed


def number_attempts(observations: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Adds ``attempt`` (from 0) to the observations of each page, or only to the first ``limit`` of them.

    With a limit the rank filter is also applied before the exchange, so a page with very many
    observations sends at most ``limit`` rows per input partition.
    """
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    numbered = observations.withColumn("nth", nth)
    if limit is not None:
        numbered = numbered.where(F.col("nth") <= limit)
    return numbered.withColumn("attempt", F.col("nth") - 1).drop("nth")


def stable_round(
    snapshots: DataFrame,
    measures: list[str],
    k: int = fixed.HEIGHT_STABLE_ROUNDS,
    cap: int = fixed.HEIGHT_MAX_STEPS,
    initial: int | None = 0,
) -> DataFrame:
    """``page_id, stop_attempt, is_stable``: first round after ``k`` rounds without change.

    Rounds without a measure are skipped. Without ``k`` such rounds the last round below the cap
    stands. ``initial`` is what the first round is compared to; None lets it always count as a change.
    """
    seen = F.lit(True)
    for m in measures:
        seen = seen & F.col(m).isNotNull()
    rounds = snapshots.where((F.col("attempt") < cap) & seen).select("page_id", "attempt", F.struct(*measures).alias("m"))
    order = Window.partitionBy("page_id").orderBy("attempt")
    before = F.lag("m").over(order)
    if initial is not None:
        before = F.coalesce(before, F.struct(*[F.lit(initial).cast(snapshots.schema[m].dataType).alias(m) for m in measures]))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rounds.withColumn("changed", (~F.col("m").eqNullSafe(before)).cast("int"))
    marked = marked.withColumn("island", F.sum("changed").over(running))
    in_island = Window.partitionBy("page_id", "island").orderBy("attempt").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    counted = marked.withColumn("unchanged", F.sum(1 - F.col("changed")).over(in_island))
    stop = F.min(F.when(F.col("unchanged") >= k, F.col("attempt")))
    return counted.groupBy("page_id").agg(
        F.coalesce(stop, F.max("attempt")).alias("stop_attempt"), stop.isNotNull().alias("is_stable")
    )


def stable_pending(snapshots: DataFrame, k: int = fixed.PENDING_STABLE_ROUNDS, cap: int = fixed.PENDING_MAX_ROUNDS) -> DataFrame:
    """Stable round of the pair (unknown, shimmer)."""
    return stable_round(snapshots, ["n_unknown", "n_shimmer"], k, cap, initial=None)


def pick_attempt(snapshots: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """``page_id, attempt, html, is_clean``: first clean attempt within the retries, else the last."""
    tried = snapshots.where(F.col("attempt") <= max_retries)
    clean = F.col("clean")
    this = F.struct("attempt", "html")
    best = tried.groupBy("page_id").agg(
        F.min(F.when(clean, this)).alias("first_clean"), F.max(this).alias("last")
    )
    chosen = F.coalesce("first_clean", "last")
    return best.select(
        "page_id",
        chosen.getField("attempt").alias("attempt"),
        chosen.getField("html").alias("html"),
        F.col("first_clean").isNotNull().alias("is_clean"),
    )


def placeholder_rounds(snapshots: DataFrame, count: str = "n_placeholders", cap: int = fixed.PHRASE_MAX_ROUNDS) -> DataFrame:
    """``page_id, rounds, is_clear``: rounds until no phrase is visible, at most ``cap``."""
    tried = snapshots.where(F.col("attempt") < cap)
    clear = F.min(F.when(F.col(count) == 0, F.col("attempt")))
    return tried.groupBy("page_id").agg(
        F.coalesce(clear, F.max("attempt") + 1).alias("rounds"), clear.isNotNull().alias("is_clear")
    )
