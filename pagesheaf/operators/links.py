"""Links between pages and the documents joined along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup, names, urls
from pagesheaf.functions.text import blank_to_null, dedup_first, html_unescape, let, strip
from pagesheaf.operators.skew import first_per_key, skew_safe_join


def _anchors(html: Column) -> Column:
    """Array of ``struct(attrs, inner)``, one per anchor, in document order.

    Each anchor ends at its close tag or at the next anchor.
    """
    clean = markup.remove_elements(markup.plain_tags(html), ["script", "style"], comments=True)
    pieces = F.split(clean, r"(?i)<a(?=[\s>/])")
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(
        rest,
        lambda p: F.struct(
            F.substring_index(p, ">", 1).alias("attrs"),
            F.regexp_replace(F.regexp_extract(p, r"(?s)^[^>]*>(.*)$", 1), r"(?is)</a[\s>].*$", "").alias("inner"),
        ),
    )


def _anchor_text(inner: Column) -> Column:
    """Stripped text nodes joined without a separator."""
    parts = F.transform(F.split(inner, r"<[^>]*>"), lambda t: strip(html_unescape(t)))
    return F.when(F.contains(inner, F.lit("<")), F.array_join(parts, "")).otherwise(strip(html_unescape(inner)))


def page_links(pages: DataFrame, host_regex: str = fixed.PAGE_HOST_REGEX) -> DataFrame:
    """Links to other pages: ``page_id, pos, href, url, text, target_id``.

    One row per page and target id, the first wins; the page itself is left out. All of it happens
    inside the page's row, so no exchange is needed.
    """
    self_id = urls.page_hex_id(F.col("url"))

    def resolve(href: Column) -> Column:
        return F.when(F.startswith(href, F.lit("http")), href).otherwise(urls.resolve_url(F.col("url"), href))

    source = pages.where(F.contains(F.lower("html"), F.lit("<a"))).select(
        "page_id", "url", self_id.alias("self_id"), _anchors(F.col("html")).alias("anchors")
    )
    found = F.transform(
        "anchors",
        lambda a, i: let(
            strip(markup.attr(a.getField("attrs"), "href")),
            lambda href: F.struct(
                i.alias("pos"), href.alias("href"), resolve(href).alias("url"), a.getField("inner").alias("inner")
            ),
        ),
    )
    hosted = F.filter(found, lambda a: (a.getField("href") != "") & urls.is_page_host(a.getField("url"), host_regex))
    keyed = F.transform(
        hosted,
        lambda a: F.struct(
            a.getField("pos").alias("pos"),
            a.getField("href").alias("href"),
            a.getField("url").alias("url"),
            F.coalesce(blank_to_null(_anchor_text(a.getField("inner"))), a.getField("url")).alias("text"),
            urls.page_hex_id(a.getField("url")).alias("target_id"),
        ),
    )
    wanted = F.filter(
        keyed, lambda a: (a.getField("target_id") != "") & (a.getField("target_id") != F.col("self_id"))
    )
    rows = source.select("page_id", F.explode(dedup_first(wanted, "target_id", "pos")).alias("link"))
    return rows.select("page_id", "link.*")


def variant_links(pages: DataFrame) -> DataFrame:
    """Quoted absolute addresses ending in the page's own key, or the key and a number.

    ``page_id, pos, href`` with positions from 1; repeats and the page's own address are left out.
    """
    source = pages.select(
        "page_id",
        "url",
        urls.page_key(F.col("url")).alias("key"),
        F.array_distinct(
            F.regexp_extract_all("html", F.lit(r'href="(https?://[^"]*)"'), F.lit(1))
        ).alias("hrefs"),
    ).where((F.col("key") != "") & (F.size("hrefs") > 0))
    wanted = F.filter(
        "hrefs",
        lambda h: (h != F.col("url"))
        & (F.endswith(h, F.col("key")) | F.endswith(F.regexp_replace(h, "-[0-9]+$", ""), F.col("key"))),
    )
    return source.select("page_id", F.posexplode(wanted).alias("pos", "href")).select(
        "page_id", (F.col("pos") + 1).alias("pos"), "href"
    )


def link_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"))


def link_targets(links: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolve links to stored pages: (resolved with ``child_id``, unresolved).

    Several stored copies of a page stand for one target; the lowest id is used. Ids are joined
    first, documents later, so the skewed key is only ever carried by narrow rows.
    """
    stored = pages.select(urls.page_hex_id(F.col("url")).alias("target_id"), F.col("page_id").alias("child_id"))
    lookup = first_per_key(stored.where(F.col("target_id") != ""), "target_id", ["child_id"])
    joined = skew_safe_join(links, lookup, "target_id", ["page_id", "pos"], "left")
    return joined.where(F.col("child_id").isNotNull()), joined.where(F.col("child_id").isNull()).drop("child_id")


def document_folders(pages: DataFrame) -> DataFrame:
    """``child_id, folder``: folder and file stem a page gets as a sub-document."""
    title = F.coalesce(
        blank_to_null(markup.extract_title(F.col("html"))),
        blank_to_null(urls.page_key(F.col("url"))),
        F.lit(fixed.DEFAULT_SUBDOCUMENT),
    )
    safe = F.coalesce(
        blank_to_null(F.substring(names.sanitize_filename(title), 1, fixed.NAME_LIMIT)),
        F.lit(fixed.DEFAULT_SUBDOCUMENT),
    )
    return pages.select(F.col("page_id").alias("child_id"), safe.alias("folder"))


def subdocuments(resolved: DataFrame, folders: DataFrame) -> DataFrame:
    """``parent_id, pos, url, child_id, child_path``: linked pages as files of their parent, without their texts.

    ``resolved`` comes from ``link_targets``, ``folders`` from ``document_folders``; both are best stored before.
    """
    narrow = resolved.select(F.col("page_id").alias("parent_id"), "pos", "url", "child_id")
    path = F.concat("folder", F.lit("/"), "folder", F.lit(".md"))
    return skew_safe_join(narrow, folders, "child_id", ["parent_id", "pos"]).select(
        "parent_id", "pos", "url", "child_id", path.alias("child_path")
    )


def linked_documents(members: DataFrame, folders: DataFrame, markdown: DataFrame) -> DataFrame:
    """``child_id, folder, child_md``: each linked page once, however often it is linked."""
    linked = folders.join(members.select("child_id").distinct(), "child_id", "left_semi")
    return linked.join(markdown.select(F.col("page_id").alias("child_id"), F.col("md").alias("child_md")), "child_id")


def subdocument_files(members: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per file below a parent, text included: for a sink that stores every copy."""
    texts = documents.select("child_id", "child_md")
    return skew_safe_join(members, texts, "child_id", ["parent_id", "pos"]).select(*members.columns, "child_md")


def variant_targets(variants: DataFrame, pages: DataFrame) -> DataFrame:
    """Variant links to stored addresses, with ``child_id``; of several copies the lowest id."""
    by_url = first_per_key(
        pages.select(F.col("url").alias("href"), F.col("page_id").alias("child_id")), "href", ["child_id"]
    )
    return skew_safe_join(variants, by_url, "href", ["page_id", "pos"])


def append_subpages(markdown: DataFrame, resolved: DataFrame, child_text: Column | None = None) -> DataFrame:
    """Append each stored variant page: ``page_id, md, n_subpages``.

    ``resolved`` comes from ``variant_targets``, best stored before. What is collected per page is
    the output document itself. ``child_text`` may change a child's text by the columns of its link and of its own
    row, which are named ``child_…``.
    """
    texts = markdown.select(*[F.col(c).alias("child_id" if c == "page_id" else f"child_{c}") for c in markdown.columns])
    body = F.col("child_md") if child_text is None else child_text
    parts = skew_safe_join(resolved, texts, "child_id", ["page_id", "pos"])
    section = F.concat(F.lit("\n\n---\n\n## Subpage: "), "href", F.lit("\n\n"), body)
    appended = parts.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", section.alias("md")))).alias("sections")
    )
    return markdown.join(appended, "page_id", "left").select(
        "page_id",
        F.concat(
            "md",
            F.coalesce(F.array_join(F.transform("sections", lambda s: s.getField("md")), ""), F.lit("")),
        ).alias("md"),
        F.when(F.col("sections").isNull(), 0).otherwise(F.size("sections")).alias("n_subpages"),
    )


def _replace_all(text: Column, pairs: Column) -> Column:
    """Apply ``struct(pos, old, new)`` replacements one after another."""
    return F.aggregate(pairs, text, lambda t, p: F.replace(t, p.getField("old"), p.getField("new")))


def rewrite_links(markdown: DataFrame, mapping: DataFrame) -> DataFrame:
    """Point ``](url)`` at the local path. ``mapping``: ``page_id, pos, url, rel_path``."""
    pairs = mapping.groupBy("page_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos",
                    F.concat(F.lit("]("), "url", F.lit(")")).alias("old"),
                    F.concat(F.lit("]("), urls.quote_path(F.col("rel_path")), F.lit(")")).alias("new"),
                )
            )
        ).alias("pairs")
    )
    joined = markdown.join(pairs, "page_id", "left")
    return joined.withColumn(
        "md", F.when(F.col("pairs").isNull(), F.col("md")).otherwise(_replace_all(F.col("md"), F.col("pairs")))
    ).drop("pairs")


def filter_seen(links: DataFrame, own_url: str = "page_url", href: str = "href") -> DataFrame:
    """Ordered distinct: drop links to the page itself and repeats, the first position stays."""
    seen = Window.partitionBy("page_id", href).orderBy("pos")
    return (
        links.where(~F.col(href).eqNullSafe(F.col(own_url)))
        .withColumn("nth", F.row_number().over(seen))
        .where(F.col("nth") == 1)
        .drop("nth")
    )
