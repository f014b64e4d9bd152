"""HTML to tokens, and the running context every structural rule uses.

A page is one row, so tokenising is a projection plus ``posexplode``. Everything that needs order
is a window over the page key. ``html_tokens(..., cluster=True)`` hashes the *pages* on that key
before they are exploded: the explode keeps the partitioning, so the windows, aggregations and
joins that follow on the same key add no exchange, and what crosses the network is the stored
page and not its several times larger token table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup
from pagesheaf.functions.text import html_unescape

# Comment, tag or declaration, text, and a lone angle bracket.
TOKEN = r"(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>|[^<]+|<"
_TAG_NAME = r"^</?([A-Za-z][^\s/>]*)"
TAG_ATTRS = r"(?s)^<[A-Za-z][^\s/>]*(.*?)/?>$"

KEYS = ["page_id"]

# Sorting the tokens of a page takes far more memory than its HTML, so this is what one partition of pages holds.
PARTITION_BYTES = 2 << 20


def strip_noncontent(pages: DataFrame, tags: list[str] = fixed.NONCONTENT_TAGS) -> DataFrame:
    """Remove scripts, styles and similar elements, content included."""
    return pages.withColumn("html", markup.remove_elements(markup.plain_tags(F.col("html")), tags))


def page_partitions(pages: DataFrame, column: str = "html") -> int | None:
    """Partitions that hold ``PARTITION_BYTES`` of a column at most on average, a multiple of the cores; None for a table that fits into one."""
    size = 0 if pages.isStreaming else pages.agg(F.sum(F.octet_length(column))).first()[0] or 0
    if size <= PARTITION_BYTES:
        return None
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return cores * math.ceil(size / PARTITION_BYTES / cores)


def clustered(pages: DataFrame, keys: list[str] = KEYS, partitions: int | None = None, column: str = "html") -> DataFrame:
    """Pages hashed on their key, in ``partitions`` or as many as their size asks for (one pass to measure it).

    A number that is given isn't changed by adaptive execution, which would merge partitions by the size of the compressed pages.
    """
    number = partitions or page_partitions(pages, column)
    return pages.repartition(*([number] if number else []), *[F.col(k) for k in keys])


def html_tokens(
    pages: DataFrame, keys: list[str] = KEYS, cluster: bool = False, keep_raw: bool = False
) -> DataFrame:
    """One row per token: ``keys, pos, kind, tag, attrs, text`` (and ``raw`` on request).

    A tag ends at the first ``>`` outside a quoted value; angle brackets in values come as character references.
    """
    source = clustered(pages, keys) if cluster else pages
    raw = F.col("raw")
    exploded = source.select(
        *keys, F.posexplode(F.regexp_extract_all(markup.plain_tags(F.col("html")), F.lit(TOKEN), F.lit(0))).alias("pos", "raw")
    )
    kind = (
        F.when(F.startswith(raw, F.lit("</")), "close")
        .when(raw.rlike("^<[A-Za-z]"), "open")
        .when(raw.rlike(r"(?s)^<[!?].*>$"), "comment")
        .otherwise("text")
    )
    out = exploded.withColumn("kind", kind).select(
        *keys,
        "pos",
        "kind",
        F.when(F.col("kind").isin("open", "close"), F.lower(F.regexp_extract(raw, _TAG_NAME, 1))).alias("tag"),
        F.when(F.col("kind") == "open", F.trim(F.regexp_extract(raw, TAG_ATTRS, 1))).alias("attrs"),
        F.when(F.col("kind") == "text", html_unescape(raw))
        .when(F.col("kind") == "comment", raw)
        .alias("text"),
        *([raw] if keep_raw else []),
    )
    return out


# --- windows --------------------------------------------------------------------------------


def in_order(keys: list[str], *more: str):
    return Window.partitionBy(*keys, *more).orderBy("pos")


def upto_here(keys: list[str], *more: str):
    return in_order(keys, *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before_here(keys: list[str], *more: str):
    return in_order(keys, *more).rowsBetween(Window.unboundedPreceding, -1)


def whole_group(keys: list[str], *more: str):
    return in_order(keys, *more).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _step() -> Column:
    """+1 at an opening tag, -1 at a closing tag; void elements never open anything."""
    return (
        F.when(F.col("tag").isin(*fixed.VOID_TAGS), 0)
        .when(F.col("kind") == "open", 1)
        .when(F.col("kind") == "close", -1)
        .otherwise(0)
    )


def pair_tags(tokens: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds ``step`` (+1, -1, 0; stray closes are 0) and ``lvl``, the depth per tag name.

    Within one (tag, lvl) opening and closing tokens alternate, so the open token of a close is
    its predecessor there.
    """
    by_tag = [*keys, "tag"]
    out = tokens.withColumn("step", _step())
    out = out.withColumn("depth", F.sum("step").over(upto_here(by_tag)))
    out = out.withColumn("low", F.coalesce(F.min("depth").over(before_here(by_tag)), F.lit(0)))
    out = out.withColumn("low", F.least("low", F.lit(0)))
    stray = (F.col("step") == -1) & (F.col("depth") < F.col("low"))
    level = F.col("depth") - F.least("low", "depth")
    return (
        out.withColumn("lvl", F.when(F.col("step") == -1, level + 1).otherwise(level))
        .withColumn("step", F.when(stray, 0).otherwise(F.col("step")))
        .drop("depth", "low")
    )


def token_context(tokens: DataFrame, names: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Adds ``in_<name>``: how many elements of that name are open at the token."""
    out = pair_tags(tokens, keys)
    run = upto_here(keys)
    for name in names:
        out = out.withColumn(
            f"in_{name}", F.sum(F.when(F.col("tag") == name, F.col("step")).otherwise(0)).over(run)
        )
    return out.drop("step", "lvl")


def _selector_rank(selectors) -> Column:
    classes = markup.attr(F.col("attrs"), "class", decode=False)
    rank = F.lit(None).cast("int")
    for number, (tag, word, part) in reversed(list(enumerate(selectors))):
        test = F.col("kind") == "open"
        if tag:
            test = test & (F.col("tag") == tag)
        if word:
            test = test & F.array_contains(F.split(classes, r"\s+"), word)
        if part:
            test = test & F.contains(classes, F.lit(part))
        rank = F.when(test, F.lit(number)).otherwise(rank)
    return rank


def content_root(
    tokens: DataFrame, selectors=None, keys: list[str] = KEYS, keep_close: bool = True
) -> DataFrame:
    """Keep the tokens of the first element matching the best selector; no match keeps the page.

    ``keep_close=False`` leaves out the root's own close tag, and with it what follows that tag in
    a segment table.
    """
    ranked = tokens.withColumn("rank", _selector_rank(selectors or fixed.CONTENT_SELECTORS))
    mark = F.when(F.col("rank").isNotNull(), F.struct("rank", "pos", "tag"))
    rooted = ranked.withColumn("root", F.min(mark).over(whole_group(keys))).where(
        F.col("root").isNull() | (F.col("pos") >= F.col("root.pos"))
    )
    same_tag = F.when(F.col("tag") == F.col("root.tag"), _step()).otherwise(0)
    closing = (F.col("depth") <= 0) & (F.col("kind") == "close")
    return (
        rooted.withColumn("depth", F.sum(same_tag).over(upto_here(keys)))
        .withColumn(
            "ended",
            F.coalesce(F.max(closing).over(before_here(keys) if keep_close else upto_here(keys)), F.lit(False)),
        )
        .where(F.col("root").isNull() | ~F.col("ended"))
        .drop("rank", "root", "depth", "ended")
    )


def paired_ends(tokens: DataFrame, keys: list[str] = KEYS, *counts: str) -> DataFrame:
    """Adds ``step`` and ``lvl`` of ``pair_tags``, ``inner`` and ``end``.

    ``end`` is, at the open token of an element, the ``pos`` (and ``counts``) of the close token it ends with: its own, or
    that of the closest element around it that has one. NULL where it lasts to the end of the page. ``inner`` says that
    the element has no close token of its own. Elements without one are looked up by depth: the close of
    the surroundings is the next one from that depth. Windows over the page only.
    """
    here = F.struct("pos", *counts)
    own = in_order([*keys, "tag", "lvl"])
    opens, closes = F.col("step") == 1, F.col("step") == -1
    paired = pair_tags(tokens, keys).withColumn("end", F.when(opens & (F.lead("step").over(own) == -1), F.lead(here).over(own)))
    loose = opens & F.col("end").isNull()
    depth = F.sum(F.when(closes, -1).when(F.col("end").isNotNull(), 1).otherwise(0)).over(upto_here(keys))
    # A closed element's tags enclose everything between them, so the depth falls below a token's at its surroundings' close first.
    levelled = paired.withColumns({"inner": loose, "level": F.when(closes, depth + 1).when(loose, depth)})
    later = Window.partitionBy(*keys, "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    around = F.last(F.when(closes, here), ignorenulls=True).over(later)
    return levelled.withColumn("end", F.when(F.col("inner"), around).otherwise(F.col("end")))


def inside_elements(tokens: DataFrame, wanted: Column, keys: list[str] = KEYS, counts: tuple[str, ...] = ()) -> DataFrame:
    """Keep the tokens inside elements for which ``wanted`` holds at the open token.

    Adds ``around``, the number of such elements around the token, and ``starts``, true at their
    open tokens. A close token still belongs to the element it closes, but to none that only ends with it.
    ``wanted`` may ask for ``end``, which carries the columns ``counts`` of the closing token. Windows only, no join.
    """
    paired = paired_ends(tokens, keys, *counts)
    starts = F.coalesce((F.col("step") == 1) & wanted, F.lit(False))
    marked = paired.withColumn("starts", starts)
    own = F.coalesce(F.lag("starts").over(in_order([*keys, "tag", "lvl"])), F.lit(False))
    # Elements without a close of their own that end here: those opened on this level since its last close.
    opened = F.sum((F.col("starts") & F.col("inner")).cast("int")).over(upto_here(keys, "level"))
    closing = F.col("step") == -1
    marked = marked.withColumn("opened", opened)
    ended = F.coalesce(F.max(F.when(closing, F.col("opened"))).over(before_here(keys, "level")), F.lit(0))
    closed = F.when(closing & own, 1).otherwise(0)
    marked = marked.withColumns({"closed": closed, "ends": F.when(closing, closed + F.col("opened") - ended).otherwise(0)})
    step = F.col("starts").cast("int") - F.col("ends")
    return (
        marked.withColumn("around", F.sum(step).over(upto_here(keys)) + F.col("closed"))
        .where(F.col("around") > 0)
        .drop("step", "lvl", "inner", "level", "end", "opened", "closed", "ends")
    )


def element_spans(tokens: DataFrame, wanted: Column, keys: list[str] = KEYS) -> DataFrame:
    """Extent of every element for which ``wanted`` holds at its open token.

    Returns ``keys, start, end, tag, attrs``. An element without a close tag ends with the element around it, at the same
    token; ``end`` is NULL where it lasts to the end of the page.
    """
    return paired_ends(tokens, keys).where((F.col("step") == 1) & wanted).select(
        *keys, F.col("pos").alias("start"), F.col("end.pos").alias("end"), "tag", "attrs"
    )
