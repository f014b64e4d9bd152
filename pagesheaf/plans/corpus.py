"""Plans over a whole corpus: pages joined to the pages they link to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup, names, urls
from pagesheaf.operators import assets, links
from pagesheaf.operators.tokens import page_partitions
from pagesheaf.plans.markdown import pages_to_markdown
from pagesheaf.session import staged


def resolved_links(pages: DataFrame, host_regex: str = fixed.PAGE_HOST_REGEX) -> tuple[DataFrame, DataFrame]:
    """Links of all pages, extracted and stored once: (resolved, unresolved)."""
    found = staged(links.page_links(pages, host_regex), "links")
    return links.link_targets(found, pages)


def pages_with_subdocuments(
    pages: DataFrame, markdown: DataFrame, host_regex: str = fixed.PAGE_HOST_REGEX
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents with local links, their files, and the linked documents: (markdown, members, documents).

    A sub-document goes one level deep; its path is relative to the parent's folder. ``members`` holds the links as narrow
    rows (``links.subdocuments``), ``documents`` every linked page once (``links.linked_documents``); only a sink that
    wants a copy for each parent joins them (``links.subdocument_files``).
    """
    markdown = staged(markdown, "markdown")
    members, folders = linked_members(pages, host_regex)
    return _with_local_links(markdown, members), members, links.linked_documents(members, folders, markdown)


def linked_members(pages: DataFrame, host_regex: str = fixed.PAGE_HOST_REGEX) -> tuple[DataFrame, DataFrame]:
    """Links to stored pages as files of their parent, and the folder of every page: (members, folders). Nothing is rendered."""
    targets = staged(resolved_links(pages, host_regex)[0], "targets")
    folders = staged(links.document_folders(pages), "folders")
    return staged(links.subdocuments(targets, folders), "members"), folders


def linked_pages(pages: DataFrame, members: DataFrame) -> DataFrame:
    """The pages that a link leads to, stored."""
    ids = members.select(F.col("child_id").alias("page_id")).distinct()
    return staged(pages.join(ids, "page_id", "left_semi"), "linked-pages")


def linked_documents(
    pages: DataFrame, selectors=None, host_regex: str = fixed.PAGE_HOST_REGEX, texts: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``members`` and ``documents`` of ``pages_with_subdocuments`` alone: links are resolved first, so that only linked pages are rendered.

    ``texts`` are the pages to render, if they are other ones than those with the links.
    """
    members, folders = linked_members(pages, host_regex)
    markdown = pages_to_markdown(linked_pages(pages if texts is None else texts, members), selectors)
    return members, links.linked_documents(members, folders, markdown)


def _with_local_links(markdown: DataFrame, members: DataFrame) -> DataFrame:
    mapping = members.select(F.col("parent_id").alias("page_id"), "pos", "url", F.col("child_path").alias("rel_path"))
    return links.rewrite_links(markdown, mapping)


def pages_with_subpages(pages: DataFrame, markdown: DataFrame) -> DataFrame:
    """Every document with its stored variant pages appended."""
    markdown = staged(markdown, "markdown")
    targets = staged(links.variant_targets(staged(links.variant_links(pages), "variants"), pages), "variant-targets")
    return links.append_subpages(markdown, targets)


class Corpus(NamedTuple):
    """The tables of a converted corpus.

    ``documents``: ``page_id, title, out_path, md, n_subpages, sha256, n_bytes, status``. ``members``: the files below a document,
    ``parent_id, pos, url, child_id, child_path``. ``children``: ``child_id, folder, child_md``, once for each linked page.
    ``assets``: the manifest, with paths as the documents have them.
    """

    documents: DataFrame
    members: DataFrame
    children: DataFrame
    assets: DataFrame


def _marked(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", F.concat(F.lit("a"), F.md5(F.coalesce("html", F.lit("")))).alias("mark"))


def _rendered(marked: DataFrame, marks: DataFrame, selectors, host_regex: str) -> tuple[DataFrame, DataFrame]:
    """Texts of marked pages, their assets named by the mark, and the manifest: ``page_id, mark, md, empty``; both stored."""
    manifest = staged(assets.asset_manifest(marked, F.col("mark"), host_regex=host_regex), "assets")
    rendered = pages_to_markdown(assets.rewrite_assets(marked, manifest), selectors, partitions=page_partitions(marked))
    text = F.coalesce("md", F.lit("\n")).alias("md")
    markdown = staged(marks.join(rendered, "page_id", "left").select("page_id", "mark", text, F.col("md").isNull().alias("empty")), "markdown")
    return markdown, manifest


def _children(members: DataFrame, folders: DataFrame, markdown: DataFrame) -> DataFrame:
    marks = markdown.select(F.col("page_id").alias("child_id"), "mark")
    child_folder = urls.quote_path(F.concat("folder", F.lit("_assets")))
    return links.linked_documents(members, folders, markdown).join(marks, "child_id").select(
        "child_id", "folder", F.replace("child_md", F.col("mark"), child_folder).alias("child_md")
    )


def corpus_children(pages: DataFrame, selectors=None, host_regex: str = fixed.PAGE_HOST_REGEX) -> DataFrame:
    """``children`` of ``convert_corpus`` alone: links are resolved first, so that only linked pages are rendered."""
    members, folders = linked_members(pages, host_regex)
    marked = _marked(linked_pages(pages, members))
    return _children(members, folders, _rendered(marked, marked.select("page_id", "mark"), selectors, host_regex)[0])


def convert_corpus(
    pages: DataFrame, base_dir: str, ts: Column, selectors=None, host_regex: str = fixed.PAGE_HOST_REGEX
) -> Corpus:
    """Convert whole pages: assets first, then Markdown, appended subpages, and links to local files.

    A page is rendered once. Its text names its assets by a mark made from its content, which is replaced where the
    folder is known: ``<stem>_assets`` in its own document, ``<folder>_assets`` as a linked file, ``subpage_<i>``, relative to the
    assets folder, where it is appended to another one. A page without content has an empty document and the status ``empty``.
    """
    marked = _marked(pages)
    title = markup.extract_title(F.col("html"))
    layout = staged(marked.select("page_id", "url", "mark", title.alias("title")), "layout")
    folder = names.output_folder(F.lit(base_dir), F.col("title"), F.col("url"), ts)
    layout = layout.withColumn("folder", folder).withColumn(
        "out_path", names.output_path(F.col("folder"), names.output_name(F.col("title"), F.col("url")))
    )
    own_folder = F.substring_index(names.assets_folder(F.col("folder"), F.col("out_path"), F.lit(None).cast("string")), "/", -1)
    layout = layout.select("page_id", "mark", "title", "out_path", urls.quote_path(own_folder).alias("own_folder"))

    markdown, manifest = _rendered(marked, layout.select("page_id", "mark"), selectors, host_regex)

    variants = staged(links.variant_targets(staged(links.variant_links(pages), "variants"), pages), "variant-targets")
    subpage_folder = F.concat(F.lit("subpage_"), F.col("pos").cast("string"))
    appended = links.append_subpages(
        markdown.select("page_id", "md", "mark"), variants, F.replace("child_md", F.col("child_mark"), subpage_folder)
    )
    members, folders = linked_members(pages, host_regex)
    whole = _with_local_links(appended, members).join(markdown.select("page_id", "empty"), "page_id").join(layout, "page_id")
    whole = whole.withColumn("md", F.replace("md", F.col("mark"), F.col("own_folder")))
    documents = whole.select(
        "page_id", "title", "out_path", "md", "n_subpages", F.sha2("md", 256).alias("sha256"),
        F.octet_length("md").cast("bigint").alias("n_bytes"), F.when(F.col("empty"), "empty").otherwise("ok").alias("status"),
    )
    children = _children(members, folders, markdown)
    placed = manifest.join(layout.select("page_id", "mark", "own_folder"), "page_id")
    placed = placed.withColumn("rel_path", F.replace("rel_path", F.col("mark"), F.col("own_folder")))
    return Corpus(documents, members, children, placed.select(*manifest.columns))
