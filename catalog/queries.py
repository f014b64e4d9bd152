"""One query per operator. Each reads whole tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalog import fixtures as fx
from pagesheaf.functions import markup, names, text, urls
from pagesheaf.operators import assets, blocks, chunks, code, lines, links, placeholders, snapshots, tokens
from pagesheaf.plans import corpus
from pagesheaf.plans import markdown as plans
from pagesheaf.session import shared_folder
from pagesheaf.sources import pages as io
from pagesheaf.streaming import snapshots as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ARTICLE = [("article", None, None)]
TS = "2024-05-06 07:08:09"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ----------------------------------------------------------------------


@query
def scan_pages(spark, sf):
    return fx.pages(spark, sf)


def _contents(spark, sf):
    """Documents as bytes, every fifth of which are not UTF-8."""
    content = F.encode("text", "UTF-8")
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(content, F.unhex(F.lit("80")))).otherwise(content)
    return fx.table(spark, sf, "documents").select("doc_id", "lang", broken.alias("content"))


def _text_file():
    """``<lang>/<doc_id>.md``; one path for every seventh document, and one outside the folder for every eleventh."""
    i = F.col("doc_id")
    name = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), i.cast("string"), F.lit(".md"))
    return F.when(i % 11 == 0, F.concat(F.lit("../"), name)).when(i % 7 == 0, F.lit("same/name.md")).otherwise(name)


@query
def scan_text_files(spark, sf):
    """Documents written as one file each and read back."""
    root = shared_folder(spark, "text-files")
    i = F.col("doc_id")
    io.write_text_files(_contents(spark, sf), root, F.concat((i % 10).cast("string"), F.lit("/"), i.cast("string"), F.lit(".md")), F.col("content"), i)
    found = io.scan_text_files(spark, root, "*.md")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.md$", 1).cast("bigint").alias("doc_id"), "n_bytes", "text", "status")


@query
def write_text_files(spark, sf):
    """The report of written files, those that could not be written included."""
    written = io.write_text_files(_contents(spark, sf), shared_folder(spark, "text-files"), _text_file(), F.col("content"), F.col("doc_id"))
    return written.select("path", "n_bytes", "status")


@query
def write_markdown(spark, sf):
    path = shared_folder(spark, "markdown")
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("md"), "lang")
    io.write_markdown(docs, path, ["lang"])
    return spark.read.parquet(path).select("doc_id", "md", "lang")


@query
def write_side_html(spark, sf):
    path = shared_folder(spark, "html")
    io.write_side_html(fx.pages(spark, sf), path)
    return spark.read.parquet(path)


@query
def quarantine(spark, sf):
    docs = io.decode_text(_contents(spark, sf))
    good, bad = io.quarantine(docs)
    return good.select("doc_id", F.lit("good").alias("side")).unionByName(bad.select("doc_id", F.lit("bad").alias("side")))


# --- projections ----------------------------------------------------------------------------


@query
def strip_noncontent(spark, sf):
    return tokens.strip_noncontent(fx.pages(spark, sf)).select("page_id", "html")


@query
def content_root(spark, sf):
    kept = tokens.content_root(
        tokens.html_tokens(tokens.strip_noncontent(fx.pages(spark, sf)), cluster=True, keep_raw=True)
    )
    return kept.select("page_id", F.col("pos").cast("bigint").alias("pos"), "raw")


@query
def first_by_priority(spark, sf):
    """The selector list decides, not the order in the page: main wins over the earlier article."""
    main = F.concat(F.lit("</article><main>m"), F.col("page_id").cast("string"), F.lit("</main>"))
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("</article>"), main)).otherwise(F.col("html"))
    pages = tokens.strip_noncontent(fx.pages(spark, sf).withColumn("html", html))
    root = tokens.content_root(tokens.html_tokens(pages, cluster=True))
    return root.groupBy("page_id").agg(F.min_by("tag", "pos").alias("root"), F.count("*").alias("n_tokens"))


@query
def extract_title(spark, sf):
    return fx.title_pages(spark, sf).select("page_id", markup.extract_title(F.col("html")).alias("title"))


@query
def strip_noncontent_comments(spark, sf):
    return tokens.strip_noncontent(fx.commented_pages(spark, sf)).select("page_id", "html")


@query
def extract_title_comments(spark, sf):
    return fx.commented_pages(spark, sf).select("page_id", markup.extract_title(F.col("html")).alias("title"))


@query
def extract_title_regex(spark, sf):
    return fx.title_pages(spark, sf).select("page_id", markup.extract_title_regex(F.col("html")).alias("title"))


@query
def strip_tags_text(spark, sf):
    return fx.pages(spark, sf).select("page_id", markup.strip_tags(F.col("html")).alias("text"))


@query
def page_key(spark, sf):
    both = fx.pages(spark, sf).select("page_id", "url", fx.doc_url(F.col("page_id")).alias("doc"))
    return both.select("page_id", urls.page_key(F.col("url")).alias("key"), urls.page_key(F.col("doc")).alias("doc_key"))


@query
def page_hex_id(spark, sf):
    i = F.col("page_id")
    variants = (
        F.when(i % 3 == 0, F.concat(fx.doc_url(i), F.lit("?v=1")))
        .when(i % 3 == 1, F.concat(F.lit("https://h.com/"), F.upper(F.md5(i.cast("string"))), F.lit("/tail")))
        .otherwise(F.col("url"))
    )
    return fx.pages(spark, sf).select("page_id", urls.page_hex_id(variants).alias("hex_id"))


@query
def is_page_host(spark, sf):
    return fx.pages(spark, sf).select(
        "page_id",
        urls.is_page_host(F.col("url"), fx.EXAMPLE_HOSTS).alias("is_page"),
        urls.is_page_host(fx.doc_url(F.col("page_id"))).alias("is_doc"),
    )


def _some_href():
    i = F.col("page_id")
    return (
        F.when(i % 6 == 0, "#top").when(i % 6 == 1, "mailto:a@b.c").when(i % 6 == 2, "javascript:x()")
        .when(i % 6 == 3, "").when(i % 6 == 4, fx.doc_url(i)).otherwise(F.concat(F.lit("../f-"), i.cast("string"), F.lit(".pdf")))
    )


@query
def is_fetchable_href(spark, sf):
    href = _some_href()
    return fx.pages(spark, sf).select(
        "page_id", urls.is_fetchable_href(href, urls.resolve_url(F.col("url"), href)).alias("fetchable")
    )


def _image_attrs():
    i = F.col("page_id")
    cls = F.when(i % 5 == 0, "icon notion-emoji").otherwise("icon")
    src = F.when(i % 5 == 1, "https://x.com/notion-emojis/1.png").when(i % 5 == 2, "data:image/gif;base64,R0").otherwise("/i.png")
    alt = F.when(i % 2 == 0, "😊 smile").otherwise("emoji")
    return F.concat(
        F.lit('class="'), cls, F.lit('" alt="'), alt, F.lit('" '),
        F.when(i % 3 == 0, F.concat(F.lit('src="'), src, F.lit('"')))
        .when(i % 3 == 1, F.concat(F.lit("data-src='"), src, F.lit("'"))).otherwise('srcset="/images/a.png 1x, /images/b.png 2x"'),
    )


@query
def is_emoji_img(spark, sf):
    return fx.pages(spark, sf).select("page_id", markup.is_emoji_img(_image_attrs()).alias("is_emoji"))


@query
def emoji_to_text(spark, sf):
    return fx.pages(spark, sf).select("page_id", markup.emoji_text(_image_attrs()).alias("text"))


@query
def image_src(spark, sf):
    return fx.pages(spark, sf).select("page_id", markup.image_src(_image_attrs()).alias("src"))


@query
def attr(spark, sf):
    a = _image_attrs()
    return fx.pages(spark, sf).select(
        "page_id", markup.attr(a, "alt").alias("alt"), markup.attr(a, "data-src").alias("data_src"), markup.attr(a, "none").alias("none")
    )


@query
def is_placeholder_literal(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.is_placeholder_literal(F.col("text"), ["The", "xyz"]).alias("hit")
    )


@query
def is_loading_phrase(spark, sf):
    i = F.col("doc_id")
    phrase = (
        F.when(i % 4 == 0, "  Carregando codigo ").when(i % 4 == 1, "Loading Plain Text").when(i % 4 == 2, "Loading").otherwise(F.col("text"))
    )
    return fx.table(spark, sf, "documents").select("doc_id", text.is_loading_phrase(phrase).alias("hit"))


# --- structure ------------------------------------------------------------------------------


@query
def html_tokens(spark, sf):
    return tokens.html_tokens(tokens.strip_noncontent(fx.pages(spark, sf))).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "kind", "tag", "attrs", "text"
    )


@query
def token_context(spark, sf):
    all_tokens = tokens.html_tokens(tokens.strip_noncontent(fx.pages(spark, sf)), cluster=True)
    return tokens.token_context(all_tokens, ["ul", "a", "article"]).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "in_ul", "in_a", "in_article"
    )


@query
def element_ends(spark, sf):
    """Elements that the pages never close end with the article, or with the page."""
    all_tokens = tokens.html_tokens(tokens.strip_noncontent(fx.pages(spark, sf)), cluster=True)
    return tokens.element_spans(all_tokens, F.col("tag").isin("b", "p", "body", "html")).select(
        "page_id", "tag", F.col("start").cast("bigint").alias("first_pos"), F.col("end").cast("bigint").alias("last_pos")
    )


@query
def element_spans(spark, sf):
    all_tokens = tokens.html_tokens(tokens.strip_noncontent(fx.pages(spark, sf)), cluster=True)
    return tokens.element_spans(all_tokens, F.col("tag").isin("article", "nav", "li")).select(
        "page_id", "tag", F.col("start").cast("bigint").alias("first_pos"), F.col("end").cast("bigint").alias("last_pos")
    )


def _talk_blocks(spark, sf):
    return plans.pages_to_blocks(fx.block_pages(spark, sf))


@query
def page_blocks(spark, sf):
    return _talk_blocks(spark, sf).select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), "kind", F.col("level").cast("bigint").alias("level"),
        "ordered", "text",
    )


@query
def page_blocks_html(spark, sf):
    return plans.pages_to_blocks(fx.pages(spark, sf), ARTICLE).select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), "kind", F.col("level").cast("bigint").alias("level"), "text"
    )


@query
def leaf_text(spark, sf):
    segments = tokens.content_root(blocks.block_segments(fx.block_pages(spark, sf)), keep_close=False)
    return blocks.page_blocks(segments, leaf_only=True).select("page_id", F.col("block_no").cast("bigint").alias("block_no"), "text")


@query
def group_list_runs(spark, sf):
    return _talk_blocks(spark, sf).where(F.col("kind") == "list_item").select(
        "page_id", F.col("block_no").cast("bigint").alias("block_no"), F.col("run_id").cast("bigint").alias("run_id"),
        F.col("item_no").cast("bigint").alias("item_no"),
    )


@query
def block_stats(spark, sf):
    return blocks.block_stats(_talk_blocks(spark, sf))


@query
def render_markdown(spark, sf):
    return plans.pages_to_markdown(fx.block_pages(spark, sf))


@query
def pages_to_markdown(spark, sf):
    return plans.pages_to_markdown(fx.pages(spark, sf))


@query
def table_markdown(spark, sf):
    return plans.pages_to_markdown(fx.table_pages(spark, sf))


@query
def table_rows(spark, sf):
    rows = plans.pages_to_blocks(fx.table_pages(spark, sf)).where("kind = 'table_row'")
    return rows.select("page_id", F.col("level").cast("bigint").alias("row_no"), "text")


@query
def role_markdown(spark, sf):
    return plans.pages_to_markdown(fx.role_pages(spark, sf))


@query
def markdown_documents(spark, sf):
    return plans.markdown_documents(fx.pages(spark, sf), "/out", F.lit(TS).cast("timestamp"))


@query
def selectable_chunks(spark, sf):
    return chunks.selectable_chunks(fx.block_pages(spark, sf)).select("page_id", "block_id", "html")


@query
def code_blocks(spark, sf):
    page_tokens = tokens.html_tokens(tokens.strip_noncontent(fx.code_pages(spark, sf)), cluster=True)
    return code.code_blocks(page_tokens).select("page_id", "lang", "text")


@query
def code_blocks_nested(spark, sf):
    """Code elements inside others, without an end, or preformatted themselves."""
    page_tokens = tokens.html_tokens(tokens.strip_noncontent(fx.nested_code_pages(spark, sf)), cluster=True)
    return code.code_blocks(page_tokens).select("page_id", "lang", "text")


@query
def code_blocks_by_spans(spark, sf):
    """Pages without a marked code element fall back on elements of many spans."""
    page_tokens = tokens.html_tokens(tokens.strip_noncontent(fx.many_span_pages(spark, sf)), cluster=True)
    return code.code_blocks(page_tokens, span_fallback=True).select("page_id", "lang", "text")


@query
def code_blocks_regex(spark, sf):
    return code.code_blocks_regex(fx.code_pages(spark, sf)).select("page_id", "lang", "text")


@query
def code_lang(spark, sf):
    i = F.col("page_id")
    attrs = (
        F.when(i % 4 == 0, 'class="x language-Go" data-language=" js "').when(i % 4 == 1, 'class="x Lang-Go y"')
        .when(i % 4 == 2, 'class="language" data-block-language="sql"').otherwise('class="x"')
    )
    return fx.pages(spark, sf).select("page_id", markup.code_lang(attrs).alias("lang"))


@query
def code_text(spark, sf):
    t = F.concat(F.lit("x ="), F.col("url"), F.lit(" &lt;loading code&gt; Loading"))
    only = F.when(F.col("page_id") % 3 == 0, "Carregando codigo").otherwise(t)
    return fx.pages(spark, sf).select("page_id", text.code_text(only, F.col("page_id") % 2 == 0).alias("text"))


# --- links ----------------------------------------------------------------------------------


@query
def page_links(spark, sf):
    return links.page_links(fx.linked_pages(spark, sf)).select("page_id", "href", "url", "text", "target_id")


@query
def page_links_quoted(spark, sf):
    """Links whose tags hold a quoted angle bracket."""
    return links.page_links(fx.quoted(fx.linked_pages(spark, sf), "a")).select("page_id", "href", "url", "text", "target_id")


@query
def variant_links(spark, sf):
    return links.variant_links(fx.variant_pages(spark, sf)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


@query
def link_counts(spark, sf):
    return links.link_counts(links.page_links(fx.linked_pages(spark, sf)))


@query
def unresolved_links(spark, sf):
    source = fx.linked_pages(spark, sf)
    return corpus.resolved_links(source)[1].select("page_id", "target_id")


@query
def subdocuments(spark, sf):
    members, documents = corpus.linked_documents(fx.linked_pages(spark, sf), ARTICLE, texts=fx.pages(spark, sf))
    return links.subdocument_files(members, documents).select("parent_id", "child_id", "child_path", "child_md")


@query
def linked_documents(spark, sf):
    """Each linked page once, whatever number of pages link to it."""
    return corpus.linked_documents(fx.linked_pages(spark, sf), ARTICLE, texts=fx.pages(spark, sf))[1]


def _corpus(spark, sf):
    return corpus.convert_corpus(fx.corpus_pages(spark, sf), "/out", F.lit(TS).cast("timestamp"), ARTICLE)


@query
def convert_corpus(spark, sf):
    """Whole documents: assets, subpages and links to local files, in one plan."""
    found = _corpus(spark, sf).documents
    return found.select("page_id", "title", "out_path", "md", F.col("n_subpages").cast("bigint").alias("n_subpages"), "n_bytes", "status")


@query
def convert_corpus_children(spark, sf):
    return corpus.corpus_children(fx.corpus_pages(spark, sf), ARTICLE)


@query
def convert_corpus_members(spark, sf):
    return corpus.linked_members(fx.corpus_pages(spark, sf))[0].select("parent_id", "url", "child_id", "child_path")


@query
def append_subpages(spark, sf):
    source = fx.variant_pages(spark, sf)
    md = source.select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit("\n")).alias("md"))
    return corpus.pages_with_subpages(source, md).select(
        "page_id", "md", F.col("n_subpages").cast("bigint").alias("n_subpages")
    )


@query
def subpage_index(spark, sf):
    source = fx.variant_pages(spark, sf)
    return links.variant_links(source).select(
        "page_id", "href", F.concat(F.lit("subpage_"), F.col("pos").cast("string")).alias("folder")
    )


@query
def rewrite_links(spark, sf):
    source = fx.linked_pages(spark, sf)
    i = F.col("page_id")
    md = source.select(
        "page_id",
        F.concat(
            F.lit("[a]("), fx.doc_url(i), F.lit(") [b]("), fx.doc_url(F.floor(i / 2)), F.lit(") [c]("), fx.doc_url(-1 - i), F.lit(")\n")
        ).alias("md"),
    )
    return corpus.pages_with_subdocuments(source, md)[0]


@query
def filter_seen(spark, sf):
    hits = fx.events(spark, sf).select(
        "page_id", F.col("event_id").alias("pos"), F.col("html").alias("href"), F.lit('{"k": 1}').alias("page_url")
    )
    return links.filter_seen(hits).select("page_id", "pos", "href")


# --- assets ---------------------------------------------------------------------------------


@query
def asset_refs(spark, sf):
    return assets.asset_refs(fx.asset_pages(spark, sf)).select("page_id", F.col("pass").cast("bigint").alias("pass"), "src", "url")


@query
def asset_refs_quoted(spark, sf):
    """References whose tags hold a quoted angle bracket."""
    refs = assets.asset_refs(fx.quoted(fx.quoted(fx.asset_pages(spark, sf), "img"), "a"))
    return refs.select("page_id", F.col("pass").cast("bigint").alias("pass"), "src", "url")


@query
def background_refs(spark, sf):
    return assets.asset_refs(fx.asset_pages(spark, sf)).where(F.col("pass") == 2).select("page_id", "src", "url")


@query
def union_of_asset_passes(spark, sf):
    return assets.asset_refs(fx.asset_pages(spark, sf)).groupBy(F.col("pass").cast("bigint").alias("pass")).agg(
        F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages")
    )


@query
def asset_manifest_by_url(spark, sf):
    found = assets.asset_manifest(fx.asset_pages(spark, sf), dedupe_urls=True)
    return found.select("page_id", F.col("pass").cast("bigint").alias("pass"), "url", "name", "status")


@query
def anchor_refs(spark, sf):
    return assets.asset_refs(fx.asset_pages(spark, sf)).where(F.col("pass") == 3).select("page_id", "src", "url")


@query
def asset_manifest(spark, sf):
    found = assets.asset_manifest(fx.asset_pages(spark, sf))
    return found.select("page_id", F.col("pass").cast("bigint").alias("pass"), "url", "name", "rel_path", "status")


@query
def unique_names(spark, sf):
    found = assets.unique_names(fx.repeated_files(spark, sf))
    return found.select("page_id", F.col("pass").cast("bigint").alias("pass"), F.col("pos").cast("bigint").alias("pos"), "name")


@query
def write_asset_manifest(spark, sf):
    path = shared_folder(spark, "manifest")
    io.write_asset_manifest(assets.asset_manifest(fx.asset_pages(spark, sf)), path)
    return spark.read.parquet(path).select("page_id", F.col("pass").cast("bigint").alias("pass"), "url", "name", "rel_path", "status")


@query
def asset_counts(spark, sf):
    return assets.asset_counts(assets.asset_manifest(fx.asset_pages(spark, sf)))


@query
def rewrite_assets(spark, sf):
    source = fx.asset_pages(spark, sf)
    return assets.rewrite_assets(source, assets.asset_manifest(source)).select("page_id", "html")


@query
def unique_renames(spark, sf):
    return assets.unique_renames(fx.odd_files(spark, sf))


@query
def sort_names(spark, sf):
    order = Window.partitionBy("page_id").orderBy("name")
    return unique_renames(spark, sf).select(
        "page_id", "name", F.row_number().over(order).cast("bigint").alias("place")
    )


@query
def rewrite_renamed(spark, sf):
    return assets.rewrite_renamed(fx.file_texts(spark, sf, "f"), unique_renames(spark, sf))


@query
def encode_asset_paths(spark, sf):
    return assets.encode_asset_paths(fx.file_texts(spark, sf, "my [f]"), fx.odd_files(spark, sf), F.lit("my [f]"))


# --- placeholders ---------------------------------------------------------------------------


@query
def placeholders_html(spark, sf):
    return placeholders.placeholders_html(fx.loading_pages(spark, sf)).select(
        "page_id", F.col("pass").cast("bigint").alias("pass"), "selector_or_snippet", "match_type", "context"
    )


@query
def placeholders_text(spark, sf):
    found = text.placeholder_matches(F.col("text"), [r"\bthe\b", "ing"], True)
    return fx.table(spark, sf, "documents").select("doc_id", found.alias("f")).select(
        "doc_id", "f.has", F.array_join("f.matches", "|").alias("matches")
    )


@query
def placeholders_text_literal(spark, sf):
    found = text.placeholder_matches(F.col("text"), ["The", "ING", "zzz"], False)
    return fx.table(spark, sf, "documents").select("doc_id", found.alias("f")).select(
        "doc_id", "f.has", F.array_join("f.matches", "|").alias("matches")
    )


@query
def placeholder_summary(spark, sf):
    found = placeholders.placeholder_summary(fx.loading_pages(spark, sf))
    return found.select("page_id", *[F.col(c).cast("bigint").alias(c) for c in found.columns[1:5]], "has_placeholders")


def _occurrences(spark, sf):
    return fx.events(spark, sf).select(
        "page_id", F.lit(1).alias("pass"), F.col("event_id").alias("pos"), F.col("html").alias("selector_or_snippet"),
        F.lit("text").alias("match_type"),
    )


@query
def union_of_placeholder_passes(spark, sf):
    found = placeholders.placeholders_html(fx.loading_pages(spark, sf))
    return found.groupBy("match_type").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


@query
def dedup_occurrences(spark, sf):
    return placeholders.dedup_occurrences(_occurrences(spark, sf)).select("page_id", "pos", "selector_or_snippet")


@query
def dedup_matches_ci(spark, sf):
    # Whole texts are exchanged, once, and not their words.
    docs = tokens.clustered(fx.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], column="text")
    words = docs.select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("pos", "match"))
    return placeholders.dedup_matches_ci(words, ["doc_id"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "match")


@query
def first_n_pending(spark, sf):
    pending = placeholders.pending_blocks(tokens.html_tokens(fx.pending_pages(spark, sf)))
    return placeholders.first_n_pending(pending, 3).select(
        "page_id", "pending", F.col("pos").cast("bigint").alias("pos"), F.col("nth").cast("bigint").alias("nth")
    )


@query
def first_n_occurrences(spark, sf):
    return placeholders.first_n_occurrences(_occurrences(spark, sf), 2).select("page_id", "selector_or_snippet", "pos")


@query
def strip_placeholder_text(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.strip_placeholder_text(F.col("text"), ["tion", "The"], [r"ing\b"]).alias("text")
    )


# --- lines ----------------------------------------------------------------------------------


@query
def md_lines(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" \r\n")).alias("md"))
    return lines.md_lines(docs).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query
def drop_placeholder_lines(spark, sf):
    return lines.drop_placeholder_lines(lines.md_lines(fx.blank_line_documents(spark, sf)), ["tion", "der"]).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


@query
def collapse_blank_runs(spark, sf):
    return fx.blank_line_documents(spark, sf).select("doc_id", lines.collapse_blank_runs(F.col("md")).alias("md"))


@query
def normalize_summary(spark, sf):
    return lines.normalize_summary(fx.blank_line_documents(spark, sf), phrases=["the "])


@query
def summary_json(spark, sf):
    return lines.summary_json(lines.normalize_summary(fx.blank_line_documents(spark, sf), phrases=["the "]))


# --- names and addresses --------------------------------------------------------------------


def _odd_title():
    return F.concat(F.lit("  a/b: "), F.col("text"), F.lit(' ?"<x>| '))


@query
def sanitize_filename(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", names.sanitize_filename(_odd_title()).alias("name"))


@query
def output_name(spark, sf):
    title = F.when(F.col("page_id") % 3 == 0, "?*").otherwise(markup.extract_title(F.col("html")))
    url = F.when(F.col("page_id") % 6 == 0, "https://x.example.com").otherwise(F.col("url"))
    return fx.pages(spark, sf).select("page_id", names.output_name(title, url).alias("name"))


@query
def output_folder(spark, sf):
    title = F.when(F.col("page_id") % 3 != 0, "A title?")
    return fx.pages(spark, sf).select(
        "page_id",
        names.output_folder(F.lit("/out"), title, fx.doc_url(F.col("page_id")), F.lit(TS).cast("timestamp")).alias("folder"),
    )


@query
def output_paths(spark, sf):
    name = F.when(F.col("page_id") % 3 == 0, "/abs/x.md").when(F.col("page_id") % 3 == 1, "sub/y.md").otherwise("z.md")
    folder = F.when(F.col("page_id") % 2 == 0, "/out/f")
    return fx.pages(spark, sf).select("page_id", names.output_path(folder, name).alias("path"))


@query
def assets_folder(spark, sf):
    i = F.col("page_id")
    given = F.when(i % 4 == 0, "/abs/a").when(i % 4 == 1, "rel").when(i % 4 == 2, "s3://b/a")
    folder = F.when(i % 2 == 0, "/out/f")
    return fx.pages(spark, sf).select("page_id", names.assets_folder(folder, F.lit("/out/f/my.page.md"), given).alias("folder"))


@query
def file_name_from_url(spark, sf):
    url = F.when(F.col("page_id") % 5 == 0, "https:///").otherwise(F.col("url"))
    return fx.pages(spark, sf).select("page_id", urls.file_name_from_url(url).alias("name"))


@query
def safe_asset_name(spark, sf):
    name = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, ".p g").otherwise(""))
    return fx.table(spark, sf, "documents").select("doc_id", names.safe_asset_name(F.replace(name, F.lit("\n"), F.lit(" "))).alias("name"))


def _some_ref():
    i = F.col("page_id")
    return (
        F.when(i % 8 == 0, "/abs/x.png").when(i % 8 == 1, "rel.png").when(i % 8 == 2, "../up/./y.png")
        .when(i % 8 == 3, "//cdn.example.com/z").when(i % 8 == 4, "https://o.org/q").when(i % 8 == 5, "?a=1")
        .when(i % 8 == 6, "#frag").otherwise("mailto:x@y.z")
    )


@query
def resolve_url(spark, sf):
    return fx.pages(spark, sf).select("page_id", urls.resolve_url(F.col("url"), _some_ref()).alias("full_url"))


@query
def quote_path(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", urls.quote_path(F.concat(F.lit("a b/~*(c)+/"), "text")).alias("quoted")
    )


@query
def asset_rel_path(spark, sf):
    return fx.pages(spark, sf).select(
        "page_id", urls.asset_rel_path(F.lit("page assets"), F.concat(F.lit("img "), F.col("page_id").cast("string"))).alias("rel")
    )


@query
def data_uri_parts(spark, sf):
    i = F.col("page_id")
    kind = F.when(i % 3 == 0, "image/png").when(i % 3 == 1, "application/pdf").otherwise("x/unknown")
    uri = F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(F.encode("url", "UTF-8")))
    broken = F.when(i % 7 == 0, "data:image/png;base64").otherwise(uri)
    return fx.pages(spark, sf).select("page_id", urls.data_uri_parts(broken).alias("p")).select(
        "page_id", "p.name", F.col("p.content").cast("string").alias("content")
    )


@query
def html_unescape(spark, sf):
    return fx.pages(spark, sf).select("page_id", text.html_unescape(F.col("html")).alias("text"))


@query
def chunk_key(spark, sf):
    block_id = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("b"), F.col("page_id").cast("string")))
    return fx.pages(spark, sf).select("page_id", chunks.chunk_key(block_id, F.col("html")).alias("key"))


# --- snapshots ------------------------------------------------------------------------------


def _event_chunks(spark, sf):
    return fx.events(spark, sf).select(
        "page_id", F.col("event_id").alias("snap"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("block_id"), "html", "ts"
    )


@query
def dedup_chunks(spark, sf):
    return chunks.dedup_chunks(_event_chunks(spark, sf)).select("page_id", "snap", "key")


@query
def dedup_chunks_last(spark, sf):
    return chunks.dedup_chunks(_event_chunks(spark, sf), keep="last").select("page_id", "snap", "first_snap", "key")


@query
def concat_chunks(spark, sf):
    source = fx.block_pages(spark, sf)
    found = chunks.selectable_chunks(source).withColumn("snap", F.lit(0))
    deduped = chunks.dedup_chunks(found.where(F.col("page_id") % 2 == 0))
    return chunks.concat_chunks(deduped, source)


@query
def stable_round(spark, sf):
    return snapshots.stable_round(fx.snapshots(spark, sf), ["height"], k=2, cap=50, initial=0).select(
        "page_id", F.col("stop_attempt").cast("bigint").alias("stop_attempt"), "is_stable"
    )


@query
def stable_pending(spark, sf):
    seen = fx.snapshots(spark, sf).withColumns({"n_unknown": F.col("height"), "n_shimmer": F.col("clean").cast("int")})
    return snapshots.stable_pending(seen, k=1).select(
        "page_id", F.col("stop_attempt").cast("bigint").alias("stop_attempt"), "is_stable"
    )


@query
def pick_attempt(spark, sf):
    return snapshots.pick_attempt(fx.snapshots(spark, sf)).select(
        "page_id", F.col("attempt").cast("bigint").alias("attempt"), "html", "is_clean"
    )


@query
def placeholder_rounds(spark, sf):
    seen = fx.snapshots(spark, sf).withColumn("n_placeholders", F.col("height"))
    return snapshots.placeholder_rounds(seen).select("page_id", F.col("rounds").cast("bigint").alias("rounds"), "is_clear")


# --- streams --------------------------------------------------------------------------------


def _run_stream(spark, stream, label, mode="append", later=()):
    """Drain a stream into files in the shared folder and read them back.

    ``later`` are functions that add to the source; the stream goes on after each of them.
    """
    out, state = shared_folder(spark, label), shared_folder(spark, f"{label}-state")
    for add in (lambda: None, *later):
        add()
        started = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
        started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _observed_stream(spark, df, label):
    """(stream of ``df``, functions that add a later observation of a page -1, so that all other pages come to an end)."""
    path = shared_folder(spark, label)
    df.write.parquet(path)

    def add(days):
        last = df.agg(*[F.max(c).alias(c) for c in df.columns]).withColumns(
            {"page_id": F.lit(-1).cast("bigint"), "attempt": F.lit(0).cast(df.schema["attempt"].dataType),
             "ts": F.col("ts") + F.expr(f"INTERVAL {days} DAY")})
        last.select(df.columns).write.mode("append").parquet(path)

    return spark.readStream.schema(df.schema).parquet(path), [lambda: add(1), lambda: add(2)]


def _event_stream(spark, sf):
    schema = fx.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def stream_first_chunks(spark, sf):
    chunk_stream = _event_stream(spark, sf).select(
        F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit(None).cast("string").alias("block_id"), F.col("props").alias("html"),
    )
    return _run_stream(spark, streams.stream_first_chunks(chunk_stream, "400 days"), "first-chunks").select("page_id", "key")


@query
def stream_pending_counts(spark, sf):
    loading = F.when(
        F.col("event_type") == "error", '<div class="notion-unknown-block"></div><div class="nds-shimmer-text"></div>'
    ).otherwise('<div class="notion-unknown-block"></div>')
    seen = _event_stream(spark, sf).select(
        F.col("user_id").alias("page_id"), F.col("ts").cast("timestamp").alias("ts"), loading.alias("html")
    )
    # Windows still open at the end of the input are not emitted.
    return _run_stream(spark, streams.stream_pending_counts(seen, "1 hour", "0 seconds"), "pending").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query
def stream_stable_pages(spark, sf):
    seen = fx.snapshots(spark, sf).select("page_id", "attempt", F.col("ts").cast("timestamp").alias("ts"), "height")
    stream, later = _observed_stream(spark, seen, "heights")
    found = _run_stream(spark, streams.stream_stable_pages(stream, k=2, cap=10), "stable", later=later)
    return found.where("page_id >= 0").select("page_id", "stop_attempt", "is_stable")


@query
def stream_complete_pages(spark, sf):
    seen = fx.snapshots(spark, sf).select("page_id", "attempt", F.col("ts").cast("timestamp").alias("ts"), "clean", "html")
    stream, later = _observed_stream(spark, seen, "attempts")
    found = _run_stream(spark, streams.stream_complete_pages(stream), "complete", later=later)
    return found.where("page_id >= 0").select("page_id", "attempt", "html", "is_clean")
