"""Asset references: finding, naming and rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup, names, urls
from pagesheaf.operators.tokens import TAG_ATTRS, TOKEN, html_tokens

_STYLE_URL = r"""url\(["']?([^"')\s]+)["']?\)"""


def content_markup(html: Column) -> Column:
    """The page without script and style bodies, its tags as tokens show them."""
    return markup.plain_tags(markup.remove_elements(markup.plain_tags(html), ["script", "style"]))


def asset_refs(pages: DataFrame, host_regex: str = fixed.PAGE_HOST_REGEX, keep: tuple[str, ...] = ()) -> DataFrame:
    """``page_id, pass, pos, src, url``: images (1), backgrounds (2), then linked files (3).

    The page's columns ``keep`` are carried along.

    Emoji images are no assets. One scan of the tokens serves the three passes.
    """
    attrs, tag = F.col("attrs"), F.col("tag")
    bare = pages.select("page_id", F.col("url").alias("base"), *keep, content_markup(F.col("html")).alias("html"))
    tokens = html_tokens(bare, ["page_id", "base", *keep]).where(
        (F.col("kind") == "open") & (tag.isin("img", "a") | F.contains(attrs, F.lit("background")))
    )
    style = markup.attr(attrs, "style")
    image = F.when((tag == "img") & ~markup.is_emoji_img(attrs), markup.image_src(attrs))
    background = F.when(~((tag == "img") & markup.is_emoji_img(attrs)) & style.rlike("background(-image)?:"), F.regexp_extract(style, _STYLE_URL, 1))
    anchor = F.when(tag == "a", markup.attr(attrs, "href"))
    refs = F.array(
        *[
            F.struct(F.lit(n).alias("pass"), src.alias("src"))
            for n, src in ((1, image), (2, background), (3, anchor))
        ]
    )
    rows = tokens.select("page_id", "base", *keep, "pos", F.explode(refs).alias("ref")).where(
        F.coalesce(F.col("ref.src") != "", F.lit(False))
    )
    resolved = rows.select(
        "page_id", *keep, "ref.pass", "pos", "ref.src", urls.resolve_url(F.col("base"), F.col("ref.src")).alias("url")
    )
    return resolved.where((F.col("pass") < 3) | urls.is_fetchable_href(F.col("src"), F.col("url"), host_regex))


def free_names(wanted: Column, separator: str) -> Column:
    """Own names for an array of names, in its order: the name if it is free, else the first free number after its stem.

    Names without a value stay so. A fold inside the row with the names taken so far as state; its work grows with the
    square of the array, which is bounded by one page's files.
    """

    def choose(taken: Column, name: Column) -> Column:
        def numbered(n: Column) -> Column:
            return names.numbered_name(name, n, separator)

        def free(candidate: Column) -> Column:
            return ~F.coalesce(F.array_contains(taken, candidate), F.lit(False))

        # Each earlier use of the same name has taken a number of its own, so no smaller one is free.
        least = F.size(F.filter(F.slice(wanted, F.lit(1), F.size(taken)), lambda other: other == name))
        candidates = F.transform(F.sequence(least, least + F.size(taken)), numbered)
        first = F.element_at(F.array_except(candidates, taken), 1)
        return F.when(name.isNull(), F.lit(None)).when(free(name), name).when(free(numbered(least)), numbered(least)).otherwise(first)

    nothing = F.array().cast("array<string>")
    return F.aggregate(wanted, nothing, lambda taken, name: F.array_append(taken, choose(taken, name)))


def _by_page(assets: DataFrame) -> DataFrame:
    """``page_id, refs``: the assets of a page as one array in order of pass and position."""
    others = [c for c in assets.columns if c not in ("page_id", "pass", "pos")]
    return assets.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pass", "pos", *others))).alias("refs"))


def _named(by_page: DataFrame, chosen: Column) -> DataFrame:
    """One row per reference, with the name at its place in ``chosen``."""
    pairs = by_page.withColumn("chosen", chosen).select("page_id", F.posexplode("refs").alias("place", "ref"), "chosen")
    fields = [f.name for f in by_page.schema["refs"].dataType.elementType.fields if f.name != "name"]
    return pairs.select("page_id", *[f"ref.{c}" for c in fields], F.get("chosen", F.col("place")).alias("name"))


def unique_names(assets: DataFrame) -> DataFrame:
    """Give every asset of a page its own name: ``stem-1.ext``, ``stem-2.ext`` … on a clash.

    Expects ``page_id, pass, pos, name``; replaces ``name``. Rows without a name keep none.
    One exchange, of these narrow rows; the names are chosen inside the page's row.
    """
    found = _named(_by_page(assets), free_names(F.transform("refs", lambda r: r.getField("name")), "-"))
    return found.select(*assets.columns)


def asset_manifest(
    pages: DataFrame, folder: Column | None = None, dedupe_urls: bool = False, **options
) -> DataFrame:
    """The ``assets`` table: references with unique names, relative paths and a status.

    A reference that cannot be saved keeps its row with the status ``failed`` and takes no name.
    An address referenced twice is saved twice unless ``dedupe_urls`` is set. ``folder`` may depend on the page's columns.
    """
    placed = pages.withColumn("asset_folder", folder if folder is not None else F.lit("assets"))
    refs = asset_refs(placed, keep=("asset_folder",), **options).withColumn("name", urls.asset_name(F.col("url")))
    saved = F.col("name").isNotNull()
    if dedupe_urls:
        by_page = _by_page(refs).withColumn("urls", F.transform("refs", lambda r: r.getField("url")))
        firsts = F.transform("urls", lambda url: F.array_position("urls", url).cast("int") - 1)
        by_page = by_page.withColumn("firsts", firsts)
        once = F.transform("refs", lambda r, i: F.when(F.get("firsts", i) == i, r.getField("name")))
        chosen = by_page.withColumn("once", free_names(once, "-"))
        named = _named(chosen, F.transform("firsts", lambda i: F.get("once", i)))
    else:
        named = unique_names(refs)
    return named.select(
        "page_id", "pass", "pos", "src", "url", "name",
        F.when(saved, urls.asset_rel_path(F.col("asset_folder"), F.col("name"))).alias("rel_path"),
        F.when(saved, "ok").otherwise("failed").alias("status"),
    )


def asset_counts(assets: DataFrame) -> DataFrame:
    """Saved assets per page."""
    return assets.groupBy("page_id").agg(F.count_if(F.col("status") == "ok").alias("n_assets"))


_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
_MAY_REFER = r"(?is)^<(img|a)[\s/>]|^<[a-z].*background"


def _saved_tag(raw: Column, image: Column, background: Column, anchor: Column) -> Column:
    """A tag with its references replaced by saved paths; NULL for a path keeps that reference."""

    def put(text: Column, pattern: str, written: str, path: Column) -> Column:
        return F.when(path.isNull(), text).otherwise(F.replace(F.regexp_replace(text, pattern, written), F.lit("\u0001"), path))

    attrs = F.trim(F.regexp_extract(raw, TAG_ATTRS, 1))
    with_src = put(raw, rf"(?is)(\ssrc\s*=\s*){_VALUE}", "$1\"\u0001\"", image)
    out = F.when(attrs.rlike(r"(?i)(^|\s)src\s*="), with_src).otherwise(put(raw, r"\s*(/?)>$", " src=\"\u0001\"$1>", image))
    out = put(put(out, _STYLE_URL, "url('\u0001')", background), rf"(?is)(\shref\s*=\s*){_VALUE}", "$1\"\u0001\"", anchor)
    return F.when(raw.rlike(r"(?i)^<img[\s/>]") & markup.is_emoji_img(attrs), markup.emoji_text(attrs)).otherwise(out)


def rewrite_assets(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Pages whose asset references point at the saved files: ``page_id, url, html``.

    Positions are those of ``asset_refs``: scripts and styles are gone. Emoji images become their text. A page is cut,
    rewritten and put together inside its row; it is joined to one narrow row with the paths of its assets.
    """
    saved = F.col("rel_path").isNotNull()

    def paths(number: int) -> Column:
        entry = F.when(saved & (F.col("pass") == number), F.struct(F.col("pos").cast("int"), "rel_path"))
        return F.map_from_entries(F.collect_set(entry)).alias(f"paths_{number}")

    spots = assets.groupBy("page_id").agg(*[paths(n) for n in (1, 2, 3)])

    def piece(raw: Column, pos: Column) -> Column:
        found = [F.try_element_at(f"paths_{n}", pos) for n in (1, 2, 3)]
        return F.when(raw.rlike(_MAY_REFER), _saved_tag(raw, *found)).otherwise(raw)

    cut = pages.select("page_id", "url", F.regexp_extract_all(content_markup(F.col("html")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    return cut.join(spots, "page_id", "left").select("page_id", "url", F.array_join(F.transform("tokens", piece), "").alias("html"))


# --- renaming saved files -------------------------------------------------------------------


def unique_renames(assets: DataFrame) -> DataFrame:
    """``page_id, name, new_name``: safe names, clashes numbered ``stem_1.ext`` in name order.

    A name that is safe already keeps its own.
    """
    files = assets.groupBy("page_id").agg(F.collect_set("name").alias("files"))

    def entry(name: Column) -> Column:
        safe = names.safe_asset_name(name)
        return F.struct((safe != name).alias("changes"), name.alias("name"), safe.alias("safe"))

    ordered = files.withColumn("files", F.array_sort(F.transform("files", entry)))
    chosen = ordered.withColumn("chosen", free_names(F.transform("files", lambda f: f.getField("safe")), "_"))
    pairs = chosen.select("page_id", F.posexplode("files").alias("place", "file"), "chosen")
    return pairs.select("page_id", "file.name", F.get("chosen", F.col("place")).alias("new_name"))


def rewrite_renamed(markdown: DataFrame, renames: DataFrame) -> DataFrame:
    """Replace old names in the text, in name order: after a slash, after a bracket, then bare."""
    changes = renames.where(F.col("name") != F.col("new_name")).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "new_name"))).alias("changes")
    )

    def apply(text: Column, change: Column) -> Column:
        old, new = change.getField("name"), change.getField("new_name")
        for sign in ("/", "(", ""):
            text = F.replace(text, F.concat(F.lit(sign), old), F.concat(F.lit(sign), new))
        return text

    joined = markdown.join(changes, "page_id", "left")
    return joined.withColumn(
        "md", F.when(F.col("changes").isNull(), F.col("md")).otherwise(F.aggregate("changes", F.col("md"), apply))
    ).drop("changes")


def encode_asset_paths(markdown: DataFrame, assets: DataFrame, folder: Column) -> DataFrame:
    """Percent-encode ``folder/file`` where it stands in the text, in name order."""
    files = assets.where(F.col("name").isNotNull()).select("page_id", "name").distinct()
    by_page = files.groupBy("page_id").agg(F.array_sort(F.collect_list("name")).alias("files"))
    joined = markdown.join(by_page, "page_id", "left").withColumn("folder", folder)

    def apply(text: Column, name: Column) -> Column:
        raw = F.concat("folder", F.lit("/"), name)
        return F.replace(text, raw, urls.quote_path(raw))

    return joined.withColumn(
        "md", F.when(F.col("files").isNull(), F.col("md")).otherwise(F.aggregate("files", F.col("md"), apply))
    ).drop("files", "folder")
