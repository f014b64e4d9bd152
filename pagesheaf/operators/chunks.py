"""Selectable chunks of a page, their de-duplication over a crawl, and the page put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup
from pagesheaf.functions.text import blank_to_null, is_placeholder_literal
from pagesheaf.operators.tokens import KEYS, content_root, html_tokens, inside_elements, upto_here


def selectable_chunks(pages: DataFrame, keys: list[str] = KEYS, nested: bool = False) -> DataFrame:
    """``keys, pos, block_id, html`` of the selectable elements below the page content.

    The outermost by default; ``nested=True`` also returns those inside others. A token is repeated
    once per selectable element around it, so the work is that of the output.
    """
    bare = pages.withColumn("html", markup.remove_elements(F.col("html"), ["script", "style"]))
    tokens = html_tokens(bare, keys, cluster=True, keep_raw=True)
    rooted = content_root(tokens, [("div", fixed.PAGE_CONTENT_CLASS, None)], keys)
    likely = (F.col("tag") == "div") & F.contains("attrs", F.lit(fixed.SELECTABLE_CLASS))
    wanted = F.when(likely, F.array_contains(markup.class_list(F.col("attrs")), fixed.SELECTABLE_CLASS))
    inside = inside_elements(rooted, wanted, keys)
    levels = F.sequence(F.lit(1), F.col("around").cast("int")) if nested else F.array(F.lit(1))
    spread = inside.withColumn("level", F.explode(levels))
    starts = F.col("starts") & (F.col("around") == F.col("level"))
    numbered = spread.withColumn("nth", F.sum(starts.cast("int")).over(upto_here(keys, "level")))
    part = F.struct("pos", "raw")
    block_id = F.coalesce(
        blank_to_null(markup.attr(F.col("attrs"), "data-block-id")), blank_to_null(markup.attr(F.col("attrs"), "id"))
    )
    return (
        numbered.withColumn("block_id", F.when(starts, block_id))
        .groupBy(*keys, "level", "nth")
        .agg(
            F.min("pos").alias("pos"),
            F.max("block_id").alias("block_id"),
            F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p.getField("raw")), "").alias("html"),
        )
        .drop("level", "nth")
    )


def chunk_key(block_id: Column, html: Column) -> Column:
    return F.when(F.coalesce(block_id, F.lit("")) != "", F.concat(F.lit("id:"), block_id)).otherwise(
        F.concat(F.lit("h:"), F.sha1(html))
    )


def looks_clean(html: Column) -> Column:
    """No loading class and no placeholder phrase."""
    return ~html.rlike(f"{fixed.SHIMMER_CLASS}|{fixed.UNKNOWN_BLOCK_CLASS}") & ~is_placeholder_literal(html)


def dedup_chunks(chunks: DataFrame, keep: str = "first") -> DataFrame:
    """One chunk per page and key over all snapshots; adds ``key`` and ``first_pos``.

    ``keep`` is ``first``, ``last`` or ``first_clean``. Spark applies the rank filter before the
    exchange too, so copies of one chunk are thinned out where they are read.
    """
    keyed = chunks.where(F.coalesce("html", F.lit("")) != "").withColumn(
        "key", chunk_key(F.col("block_id"), F.col("html"))
    )
    order = {
        "first": [F.col("snap"), F.col("pos")],
        "last": [F.col("snap").desc(), F.col("pos").desc()],
        "first_clean": [(~looks_clean(F.col("html"))).cast("int"), F.col("snap"), F.col("pos")],
    }[keep]
    picked = F.row_number().over(Window.partitionBy("page_id", "key").orderBy(*order))
    out = keyed.withColumn("nth", picked).where(F.col("nth") == 1).drop("nth")
    if keep == "first":
        return out.withColumn("first_snap", F.col("snap")).withColumn("first_pos", F.col("pos"))
    # The place of a chunk stays that of its first sighting; the aggregate is combined before its exchange.
    first = keyed.groupBy("page_id", "key").agg(F.min(F.struct("snap", "pos")).alias("at"))
    return out.join(first, ["page_id", "key"]).select(
        *out.columns, F.col("at.snap").alias("first_snap"), F.col("at.pos").alias("first_pos")
    )


def concat_chunks(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """``page_id, html``: the chunks of a page in order, wrapped; without chunks the page itself.

    The chunks of one page form one output document.
    """
    part = F.struct("first_snap", "first_pos", "html")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p.getField("html")), "\n")
    wrapped = chunks.groupBy("page_id").agg(
        F.concat(F.lit(f'<div class="{fixed.EXPORT_CLASS}">\n'), joined, F.lit("\n</div>")).alias("export")
    )
    if pages is None:
        return wrapped.withColumnRenamed("export", "html")
    return pages.join(wrapped, "page_id", "left").select("page_id", F.coalesce("export", "html").alias("html"))
