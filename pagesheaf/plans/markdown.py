"""The page to Markdown plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup
from pagesheaf.functions.names import output_folder, output_name, output_path
from pagesheaf.operators.blocks import (
    block_segments,
    group_list_runs,
    page_blocks,
    render_markdown,
)
from pagesheaf.operators.tokens import KEYS, content_root, html_tokens, page_partitions, strip_noncontent


def page_tokens(pages: DataFrame, selectors=None, keys: list[str] = KEYS) -> DataFrame:
    """Content tokens of each page, hashed on the page key."""
    return content_root(html_tokens(strip_noncontent(pages), keys, cluster=True), selectors, keys)


def pages_to_blocks(
    pages: DataFrame, selectors=None, keys: list[str] = KEYS, partitions: int | None = None, **options
) -> DataFrame:
    """Typed blocks of each page's content root, with list runs; ``partitions`` of pages, measured if not given."""
    partitions = partitions or page_partitions(pages)
    segments = content_root(block_segments(strip_noncontent(pages), keys, partitions), selectors, keys, keep_close=False)
    return group_list_runs(page_blocks(segments, keys, **options), keys)


def pages_to_markdown(
    pages: DataFrame, selectors=None, keys: list[str] = KEYS, fence_lang: bool = False, **options
) -> DataFrame:
    """``keys, md`` for every page that has content."""
    return render_markdown(pages_to_blocks(pages, selectors, keys, **options), keys, fence_lang)


def document_titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", markup.extract_title(F.col("html")).alias("title"))


def markdown_documents(
    pages: DataFrame,
    base_dir: str | None = None,
    ts: Column | None = None,
    default_stem: str = fixed.DEFAULT_STEM,
    selectors=None,
) -> DataFrame:
    """The ``markdown`` table: title, path, text, fingerprint and size of each document.

    The title comes from the whole page, the text from its content root. Titles and texts are
    joined on the page key, a page without content keeps its row with the status ``empty``.
    """
    titles = document_titles(pages)
    texts = pages_to_markdown(pages, selectors)
    name = output_name(F.col("title"), F.col("url"), default_stem)
    folder = (
        output_folder(F.lit(base_dir), F.col("title"), F.col("url"), ts, default_stem)
        if base_dir
        else F.lit(None).cast("string")
    )
    text = F.coalesce("md", F.lit("\n"))
    return titles.join(texts, "page_id", "left").select(
        "page_id",
        "title",
        output_path(folder, name).alias("out_path"),
        text.alias("md"),
        F.sha2(text, 256).alias("sha256"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.when(F.col("md").isNull(), "empty").otherwise("ok").alias("status"),
    )
