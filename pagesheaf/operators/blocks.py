"""Pages to typed blocks.

A page is cut into segments at its block-level tags. Three running contexts give a segment its
type: the innermost vocabulary block, the open semantic elements and the open list. Each context
is a window on the page key over the one exchange that distributed the stored pages.

A root, leaf or list marker on an inline tag cuts the page as a block-level tag does. An element that wraps blocks in a
link gives each of them the link.

A table outside every other one becomes a grid: its rows, the cells of a row, and the columns that earlier rows span. One
block of kind ``table_row`` stands for a row; tables in cells are flattened to the text of their cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup
from pagesheaf.functions.text import code_text, collapse_space, html_unescape, let, strip
from pagesheaf.operators.tokens import KEYS, TOKEN, before_here, clustered, in_order, pair_tags, upto_here

# Control characters stand for inline marks until the text of a segment is whole.
_STRONG, _STRONG_END, _EM, _EM_END, _CODE, _CODE_END, _LINK, _LINK_MID, _LINK_END, _BREAK, _EQUALS = (
    "\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07", "\x08", "\x0e", "\x0f", "\x10",
)
_CUT, _ROLE = "\x11", "\x12"
_MARKS = "".join((_STRONG, _STRONG_END, _EM, _EM_END, _CODE, _CODE_END, _LINK, _LINK_MID, _LINK_END, _BREAK, _EQUALS))

_CONTENT = rf"[^ \t-\r\x{{a0}}{_MARKS}]"

_HEADINGS = [f"h{i}" for i in range(1, 7)]
# Elements that give text its kind, and the elements whose end also ends one of them that was never closed.
_KINDS = [*_HEADINGS, "blockquote", "pre", "summary"]
_SURROUNDINGS = [t for t in fixed.BLOCK_TAGS if t not in (*_KINDS, "p", "hr")]
_INDENT = "    "


def _vocabulary(classes: Column, field: int) -> Column:
    """Kind, level or order flag of the block class found in ``classes``; code needs both classes."""
    out = F.lit(None)
    for entry in reversed(fixed.BLOCK_VOCABULARY):
        out = F.when(markup.has_word(classes, entry[0]), F.lit(entry[field])).otherwise(out)
    both = F.lit(True)
    for word in fixed.CODE_CLASSES:
        both = both & F.array_contains(F.split(F.lower(classes), r"\s+"), word)
    return F.when(both, F.lit("code" if field == 1 else None)).otherwise(out)


# Classes and attributes that give an element of any name a role, at the start of a tag's text.
_ANY_NAME = [part or word for tag, word, part in fixed.CONTENT_SELECTORS if tag is None]
_ROLE_TAG = (
    rf"""(?is)^<[a-z][^\s/>]*\s(?:[^>]*[\s"'])?(?:class\s*=\s*(?:"[^"]*|'[^']*|)(?:{'|'.join([*_ANY_NAME, fixed.LIST_MARKER_CLASS])})"""
    rf"""|{fixed.LEAF_ATTRIBUTE}(?=[\s=/>]))"""
)


def _cut_roles(html: Column) -> Column:
    """Marks the tags of inline elements that have a role, open and close.

    The elements of their names are walked through in order with a stack of roles, so that a close tag is marked if its
    own open tag was. Only pages that name a role look for such tags at all, and only those that have one are walked.
    """
    inline = rf"(?i)<(?!(?:{'|'.join([*fixed.BLOCK_TAGS, *fixed.VOID_TAGS])})[\s/>])[a-z][^>]*>"
    named = html.rlike("|".join([*_ANY_NAME, fixed.LIST_MARKER_CLASS, fixed.LEAF_ATTRIBUTE]))
    found = F.filter(F.regexp_extract_all(html, F.lit(inline), F.lit(0)), lambda t: t.rlike(_ROLE_TAG))
    of_page = F.array_distinct(F.transform(found, lambda t: F.lower(F.regexp_extract(t, r"^<([^\s/>]*)", 1))))

    def walk(names: Column) -> Column:
        starts = F.concat(F.lit(r"(?i)(?=</?(?:"), F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|"), F.lit(r")[\s/>])"))

        def step(state: Column, piece: Column) -> Column:
            stack = state.getField("stack")
            closes, opens = F.startswith(piece, F.lit("</")), piece.rlike(r"^<[A-Za-z][^>]*[^/>]?>") & ~piece.rlike(r"^<[^>]*/>")
            role = F.when(closes, F.right(stack, F.lit(1)) == "1").otherwise(piece.rlike(_ROLE_TAG))
            after = F.when(closes, F.left(stack, F.length(stack) - 1)).when(opens, F.concat(stack, F.when(role, "1").otherwise("0"))).otherwise(stack)
            marked = F.when(role, F.concat(F.lit(_CUT + _ROLE), piece)).otherwise(piece)
            return F.struct(F.concat(state.getField("out"), F.array(marked)).alias("out"), after.alias("stack"))

        none = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("stack"))
        return F.array_join(F.aggregate(F.split(html, starts), none, step, lambda state: state.getField("out")), "")

    return F.when(named, let(of_page, lambda names: F.when(F.size(names) > 0, walk(names)).otherwise(html))).otherwise(html)


def block_segments(pages: DataFrame, keys: list[str] = KEYS, partitions: int | None = None) -> DataFrame:
    """One row per block-level tag, or inline tag with a role, with the inline content up to the next one.

    Cutting the page at block-level tags inside the row gives the windows a fraction of the rows a
    full token table has; inline markup is converted in the row and never crosses a sort.
    """
    html = F.regexp_replace(markup.plain_tags(F.col("html")), rf"(?s)<!--.*?-->|[{_MARKS}{_CUT}{_ROLE}]", "")
    tags = "|".join(fixed.BLOCK_TAGS)
    cut = F.regexp_replace(let(html, _cut_roles), rf"(?i)</?(?:{tags})(?=[\s/>])[^>]*>", f"{_CUT}$0")
    cut = F.regexp_replace(cut, r"(?i)<hr(?=[\s/>])[^>]*>", f"$0{_CUT}")
    pieces = (
        clustered(pages, keys, partitions)
        .select(*keys, F.posexplode(F.split(cut, _CUT)).alias("pos", "piece"))
        .withColumn("head", F.regexp_extract("piece", rf"(?i)^(?:{_ROLE}</?[a-z]|</?(?:{tags})(?=[\s/>]))[^>]*>", 0))
        .withColumns({"piece": F.translate("piece", _ROLE, ""), "head": F.translate("head", _ROLE, "")})
    )
    head = F.col("head")
    return pieces.select(
        *keys,
        "pos",
        F.when(head == "", "text").when(F.startswith(head, F.lit("</")), "close").otherwise("open").alias("kind"),
        F.when(head != "", F.lower(F.regexp_extract(head, r"^</?([A-Za-z][^\s/>]*)", 1))).alias("tag"),
        F.when(F.substring(head, 2, 1) != "/", F.trim(F.regexp_extract(head, r"(?s)^<[A-Za-z][^\s/>]*(.*?)/?>$", 1))).alias(
            "attrs"
        ),
        F.substr("piece", F.length(head) + 1).alias("body"),
    )


def _annotated(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Mark vocabulary blocks, leaves and list markers, and the close tags that end them."""
    attrs = F.col("attrs")
    has_attrs = F.coalesce((F.col("kind") == "open") & (attrs != ""), F.lit(False))
    classes = F.when(has_attrs, markup.attr(attrs, "class", decode=False)).otherwise("")
    out = segments.withColumn("classes", classes)
    is_div = (F.col("tag") == "div") & (F.col("classes") != "")
    out = (
        out.withColumn("vkind", F.when(is_div, _vocabulary(F.col("classes"), 1)))
        .withColumn("vlevel", F.when(F.col("vkind").isNotNull(), _vocabulary(F.col("classes"), 2)).cast("int"))
        .withColumn("vordered", F.when(F.col("vkind").isNotNull(), _vocabulary(F.col("classes"), 3)).cast("boolean"))
        .withColumn("leaf", has_attrs & markup.has_attr(attrs, fixed.LEAF_ATTRIBUTE))
        .withColumn("marker", markup.has_word(F.col("classes"), fixed.LIST_MARKER_CLASS))
        .withColumn("attrs", F.when((F.col("vkind") == "code") | F.col("tag").isin("pre", "td", "th"), attrs))
    )
    paired = pair_tags(out, keys)
    # In one (tag, lvl) an opening tag is followed by its closing tag; without one the element is never closed.
    following = F.coalesce(F.lead("step").over(in_order([*keys, "tag", "lvl"])), F.lit(0))
    paired = paired.withColumn("unclosed", F.col("tag").isin(*_KINDS) & (F.col("step") == 1) & (following != -1))
    roles = F.struct(F.col("vkind").isNotNull().alias("v"), "leaf", "marker")
    opener = F.lag(roles).over(in_order([*keys, "tag", "lvl"]))
    paired = paired.withColumn("opener", F.when(F.col("step") == -1, opener).when(F.col("step") == 1, roles))

    def role_step(field: str) -> Column:
        return F.when(F.coalesce(F.col(f"opener.{field}"), F.lit(False)), F.col("step")).otherwise(0)

    return paired.withColumns({f"{f[0]}_step": role_step(f) for f in ("v", "leaf", "marker")}).drop(
        "opener", "leaf", "marker", "lvl", "classes"
    )


def _tag_depth(tags: list[str], run) -> Column:
    return F.sum(F.when(F.col("tag").isin(*tags), F.col("step")).otherwise(0)).over(run)


def _with_context(marked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the innermost block and list, the running element depths and what surrounds a block."""
    run = upto_here(keys)
    # An element that is never closed ends with what surrounds it: it lasts while no more surrounding elements have
    # ended than had begun after it. It takes no part in the depths.
    marked = marked.withColumns(
        {"box_depth": _tag_depth(_SURROUNDINGS, run), "lost_no": F.sum(F.coalesce(F.col("unclosed"), F.lit(False)).cast("int")).over(run)}
    )
    lost = F.last(F.when(F.col("unclosed"), F.struct("tag", "box_depth")), ignorenulls=True).over(run)
    # The smallest depth since the last one: numbers only rise, so a running minimum needs no order of its own.
    low = F.min(F.struct((-F.col("lost_no")).alias("no"), "box_depth")).over(run).getField("box_depth")
    marked = marked.withColumns({"lost": lost, "low": low}).withColumns(
        {
            "lost": F.when(F.col("low") >= F.col("lost.box_depth"), F.col("lost.tag")),
            "step": F.when(F.coalesce(F.col("unclosed"), F.lit(False)), 0).otherwise(F.col("step")),
        }
    ).drop("low", "box_depth", "lost_no", "unclosed")
    opens = F.col("step") == 1
    lists = F.col("tag").isin("ul", "ol")
    n_images = F.when(F.contains("body", F.lit("<")), F.regexp_count("body", F.lit(r"(?i)<img\b"))).otherwise(0)
    nesting = marked.withColumns(
        {
            "v_depth": F.sum("v_step").over(run),
            "list_depth": _tag_depth(["ul", "ol"], run),
            "table_depth": _tag_depth(["table"], run),
            "thead_depth": _tag_depth(["thead"], run),
            "link": F.last(_last_anchor(F.col("body")), ignorenulls=True).over(before_here(keys)),
            "title_depth": _tag_depth([*_HEADINGS[:4], "button"], run),
            "img_no": F.sum(n_images).over(run) - n_images,
        }
    )
    block = F.struct(
        F.col("pos").alias("seg"),
        F.col("vkind").alias("kind"),
        F.col("vlevel").alias("level"),
        F.col("vordered").alias("ordered"),
        F.col("img_no").alias("img_no"),
        F.col("title_depth").alias("title_depth"),
        F.when(F.col("vkind") == "code", F.col("attrs")).alias("attrs"),
    )
    # Innermost vocabulary block or list: the latest one opened at the present nesting depth.
    innermost = F.last(F.when(F.col("v_step") == 1, block), ignorenulls=True).over(upto_here(keys, "v_depth"))
    this_list = F.last(
        F.when(lists & opens, F.struct(F.col("pos").alias("seg"), (F.col("tag") == "ol").alias("ordered"))), ignorenulls=True
    ).over(upto_here(keys, "list_depth"))
    item = F.last(F.when((F.col("tag") == "li") & opens, F.col("pos")), ignorenulls=True).over(upto_here(keys, "list_depth"))
    # Tables, rows and cells of the outermost table; a row or cell lasts to the next one.
    outermost = (F.col("kind") == "open") & (F.col("table_depth") == 1)
    table_seg = F.last(F.when(outermost & (F.col("tag") == "table"), F.col("pos")), ignorenulls=True).over(run)
    row_seg = F.last(F.when(outermost & (F.col("tag") == "tr"), F.col("pos")), ignorenulls=True).over(run)
    spans = [_span(F.coalesce("attrs", F.lit("")), f"{n}span", most).alias(a) for n, a, most in (("col", "wide", 1000), ("row", "tall", 65534))]
    cell = F.struct(F.col("pos").alias("seg"), ((F.col("tag") == "th") | (F.col("thead_depth") > 0)).alias("head"), *spans)
    cell = F.last(F.when(outermost & F.col("tag").isin("td", "th"), cell), ignorenulls=True).over(run)
    nesting = nesting.withColumns({"table_seg": table_seg, "row_seg": row_seg, "cell": cell}).withColumn(
        "cell", F.when((F.col("table_depth") > 0) & (F.col("cell.seg") > F.col("table_seg")), F.col("cell"))
    ).withColumn("row_seg", F.when(F.col("row_seg") > F.col("table_seg"), F.col("row_seg")).otherwise(F.col("table_seg"))).drop("table_depth", "thead_depth")
    placed = nesting.withColumns({"vb": innermost, "list": this_list, "item_seg": item}).withColumn(
        "vb", F.when(F.col("v_depth") > 0, F.col("vb"))
    ).drop("vlevel", "vordered", "v_depth")
    begins = opens | (F.col("kind") == "open")
    heading = F.when(F.col("tag").isin(*_HEADINGS) & begins, F.substring("tag", 2, 1).cast("int"))
    return placed.withColumns(
        {
            "l_depth": F.sum("l_step").over(run),
            "m_depth": F.sum("m_step").over(run),
            "leaf_no": F.sum((F.col("l_step") == 1).cast("int")).over(run),
            "li_depth": _tag_depth(["li"], run),
            "quote_depth": _tag_depth(["blockquote"], run),
            "pre_depth": _tag_depth(["pre"], run),
            "head_depth": _tag_depth(_HEADINGS, run),
            "summary_depth": _tag_depth(["summary"], run),
            "head_level": F.last(heading, ignorenulls=True).over(run),
            "pre_attrs": F.last(F.when((F.col("tag") == "pre") & begins, F.col("attrs")), ignorenulls=True).over(run),
            # What surrounds a block is the state just before its own first segment.
            "outer": F.lag(F.struct(F.col("vb.seg").alias("seg"), F.col("vb.kind").alias("kind"))).over(in_order(keys)),
        }
    )


def _last_anchor(body: Column) -> Column:
    """The last anchor tag of a segment: its open tag, '' if it closes or has no address, NULL if there is none."""
    last = F.regexp_extract(body, r"(?is)^.*(<a(?=[\s/>])[^>]*>|</a(?=[\s>])[^>]*>)", 1)
    return F.when(F.contains(F.lower(body), F.lit("<a")) | F.contains(F.lower(body), F.lit("</a")), F.when(
        last.rlike(r"(?i)^<a\s[^>]*href"), last).when(last != "", ""))


def _inline_piece(token: Column) -> Column:
    """Text contributed by one inline token, marks as control characters."""
    tag = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
    attrs = F.regexp_extract(token, r"(?s)^<[A-Za-z][^\s/>]*(.*?)/?>$", 1)
    is_open = F.substring(token, 2, 1) != "/"

    def image(a: Column) -> Column:
        plain = F.concat(F.lit("!["), markup.attr(a, "alt"), F.lit("]("), markup.image_src(a), F.lit(")"))
        return F.when(markup.is_emoji_img(a), markup.emoji_text(a)).otherwise(plain)

    def by_tag(t: Column) -> Column:
        return (
            F.when(t.isin("b", "strong"), F.when(is_open, _STRONG).otherwise(_STRONG_END))
            .when(t == "br", _BREAK)
            .when(t == "a", F.when(
                is_open, F.concat(F.lit(_LINK), let(attrs, lambda a: markup.attr(a, "href")), F.lit(_LINK_MID))
            ).otherwise(_LINK_END))
            .when(t == "img", let(attrs, image))
            .when(t.isin("i", "em"), F.when(is_open, _EM).otherwise(_EM_END))
            .when(t == "code", F.when(is_open, _CODE).otherwise(_CODE_END))
            .otherwise("")
        )

    is_tag = token.rlike("(?s)^<[A-Za-z/!?].*>$")
    return F.when(is_tag, let(tag, by_tag)).otherwise(html_unescape(token))


def _convert(body: Column, one: Callable[[Column], Column]) -> Column:
    tokens = F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0))
    return F.when(F.contains(body, F.lit("<")), F.array_join(F.transform(tokens, one), "")).otherwise(html_unescape(body))


def _code_piece(token: Column) -> Column:
    is_tag = token.rlike("(?s)^<[A-Za-z/!?].*>$")
    return (
        F.when(token.rlike(r"(?i)^<br[\s/>]"), "\n")
        .when(is_tag, "")
        .otherwise(let(html_unescape(token), lambda t: F.when(strip(t) == "=", F.concat(F.lit(_EQUALS), t)).otherwise(t)))
    )


def inline_markdown(raw: Column) -> Column:
    """Turn the marks of a whole segment into Markdown; an open mark ends with the segment."""
    space = rf"[\s\x{{a0}}{_BREAK}]"
    plain = strip(collapse_space(raw))
    out = plain
    for start, end, sign in ((_CODE, _CODE_END, "`"), (_EM, _EM_END, "*"), (_STRONG, _STRONG_END, "**")):
        pair = rf"{start}({space}*)([^{start}{end}]*?)({space}*)(?:{end}|\z)"
        out = F.regexp_replace(out, rf"{start}({space}*)(?:{end}|\z)", "$1")
        out = F.regexp_replace(out, pair, rf"$1{_escape(sign)}$2{_escape(sign)}$3")
        out = F.regexp_replace(out, f"[{start}{end}]", "")
    # A link around nothing is dropped, one without an address is its text.
    out = F.regexp_replace(out, rf"{_LINK}[^{_LINK_MID}]*{_LINK_MID}{space}*(?:{_LINK_END}|\z)", "")
    out = F.regexp_replace(out, rf"{_LINK}{_LINK_MID}([^{_LINK}{_LINK_END}]*)(?:{_LINK_END}|\z)", "$1")
    out = F.regexp_replace(
        out, rf"{_LINK}([^{_LINK_MID}]*){_LINK_MID}([^{_LINK}{_LINK_END}]*)(?:{_LINK_END}|\z)", "[$2]($1)"
    )
    out = F.regexp_replace(out, rf"{_LINK}[^{_LINK_MID}]*{_LINK_MID}|[{_LINK}{_LINK_MID}{_LINK_END}]", "")
    out = F.regexp_replace(out, rf"\A{space}+|{space}+\z", "")
    out = F.regexp_replace(out, rf" *{_BREAK} *", "  \n")
    return F.when(raw.rlike(f"[{_MARKS}]"), out).otherwise(plain)


def _escape(sign: str) -> str:
    return "".join("\\" + ch if ch in "$\\" else ch for ch in sign)


def page_blocks(
    segments: DataFrame, keys: list[str] = KEYS, leaf_only: bool = False, clean_code: bool = True
) -> DataFrame:
    """One row per block: ``keys, block_no, parent_block, kind, level, ordered, lang, text, place``.

    ``segments`` come from ``block_segments``, usually cut to their content root. ``block_no``
    follows document order. ``leaf_only`` drops what lies outside a block's first editable leaf,
    nested blocks included (toggles keep their members). ``place`` is (list_seg, item_seg, depth) of an item of a plain
    list: the segments where its list and its item begin, and how many lists are around that list.
    """
    context = _with_context(_annotated(segments, keys), keys)
    vkind = F.col("vb.kind")
    in_heading = (F.col("head_depth") > 0) | F.coalesce(F.col("lost").isin(*_HEADINGS), F.lit(False))
    inside = lambda tag, depth: (F.col(depth) > 0) | F.coalesce(F.col("lost") == tag, F.lit(False))
    in_item = (F.col("li_depth") > 0) & (F.col("list_depth") > 0)
    in_title = F.col("title_depth") > F.coalesce(F.col("vb.title_depth"), F.lit(0))
    kind = (
        F.when(vkind.isin("heading", "code", "divider"), vkind)
        .when(inside("pre", "pre_depth"), "code")
        .when(vkind == "toggle", F.when(in_title, "toggle_summary").when(in_heading, "heading"))
        .when(vkind.isin("quote", "list_item"), vkind)
        .when(in_heading, "heading")
        .when(inside("summary", "summary_depth"), "toggle_summary")
        .when(in_item, "list_item")
        .when(inside("blockquote", "quote_depth"), "quote")
    )
    divider = (F.col("kind") == "open") & ((F.col("tag") == "hr") | ((F.col("v_step") == 1) & (F.col("vkind") == "divider")))
    icon_here = (vkind == "quote") & (F.col("img_no") == F.col("vb.img_no"))
    no_icon = F.regexp_replace("body", r"(?is)\A(.*?)<img\b[^>]*>", "$1")
    lang_tag = F.regexp_extract("body", r"(?is)<code\b([^>]*)>", 1)
    # Segments without text are only needed where they open a block, a leaf or a cell. This asks for no more than the
    # columns below hold, so that those are made for the rows that stay.
    needed = (
        F.coalesce(divider, F.lit(False)) | (F.col("v_step") == 1) | (F.col("l_depth") > 0) | (F.coalesce("link", F.lit("")) != "")
        | F.coalesce(F.col("cell.seg") == F.col("pos"), F.lit(False)) | F.col("body").rlike(_CONTENT)
    )
    rows = context.where(needed).select(
        *keys,
        F.col("pos").alias("block_no"),
        F.coalesce(divider, F.lit(False)).alias("divider"),
        F.when(F.coalesce(divider, F.lit(False)), "divider").otherwise(F.coalesce(kind, F.lit("paragraph"))).alias("kind"),
        F.when(vkind == "heading", F.col("vb.level")).otherwise(F.col("head_level")).alias("level"),
        F.when(vkind == "list_item", F.col("vb.ordered")).otherwise(F.col("list.ordered")).alias("ordered"),
        # Items of plain lists know their list, their item and how deep they are; others have none of these.
        F.when((kind == "list_item") & F.coalesce(vkind != "list_item", F.lit(True)), F.struct(
            F.col("list.seg").alias("list_seg"), "item_seg", (F.col("list_depth") - 1).cast("int").alias("depth"))).alias("place"),
        F.concat(F.coalesce("link", F.lit("")), F.when(F.col("m_depth") > 0, "").when(icon_here, no_icon).otherwise(F.col("body"))).alias("body"),
        "table_seg", "row_seg", "cell",
        F.when(vkind == "code", F.col("vb.attrs"))
        .when(inside("pre", "pre_depth"), F.concat_ws(" ", lang_tag, "pre_attrs"))
        .alias("code_attrs"),
        F.col("vb.seg").alias("vseg"),
        vkind.alias("vkind"),
        F.when(F.col("l_depth") > 0, F.col("leaf_no")).alias("leaf_no"),
        F.when(F.col("v_step") == 1, F.col("outer")).alias("outer"),
    )
    in_block = Window.partitionBy(*keys, "vseg")
    rows = rows.withColumns(
        {"outer": F.max("outer").over(in_block), "first_leaf": F.min("leaf_no").over(in_block)}
    )
    boxed = F.col("vkind").isNotNull() & ~F.col("vkind").isin("toggle", "code")
    in_leaf = F.col("leaf_no") == F.col("first_leaf") if leaf_only else F.col("leaf_no").isNotNull()
    has_text = (F.col("kind") != "divider") & F.col("body").rlike(_CONTENT)
    kept = rows.where(
        F.col("divider")
        | F.coalesce(F.col("cell.seg") == F.col("block_no"), F.lit(False))
        | (has_text & (~boxed | F.col("first_leaf").isNull() | F.coalesce(in_leaf, F.lit(False))))
    )
    if leaf_only:
        nested = F.col("outer.kind").isin("paragraph", "list_item", "quote", "heading")
        kept = kept.where(F.col("vseg").isNull() | ~F.coalesce(nested, F.lit(False)))
    marked = F.when(F.col("kind") == "code", _convert(F.col("body"), _code_piece)).otherwise(
        _convert(F.col("body"), _inline_piece)
    )
    kept = kept.withColumn("marked", F.when(F.col("divider"), "").otherwise(marked))
    bare = F.translate("marked", _EQUALS, "")
    clean = code_text(bare, F.contains("marked", F.lit(_EQUALS))) if clean_code else bare
    code = F.when(F.col("vkind") == "code", clean).otherwise(bare)
    in_cell = F.col("cell").isNotNull()
    text = F.when((F.col("kind") == "code") & ~in_cell, code).otherwise(inline_markdown(F.col("marked")))
    # Tags alone make no block, and a link around nothing is none.
    written = kept.withColumn("text", text).where(F.col("divider") | in_cell | (F.col("kind") == "code") | (F.col("text") != ""))
    found = written.select(
        *keys,
        F.struct(
            "block_no",
            F.when(F.col("vseg").isNotNull(), F.col("outer.seg")).alias("parent_block"),
            F.when(in_cell, "table_row").otherwise(F.col("kind")).alias("kind"),
            F.when(F.col("kind") == "heading", F.col("level")).alias("level"),
            F.when(F.col("kind") == "list_item", F.coalesce("ordered", F.lit(False))).alias("ordered"),
            F.when(F.col("kind") == "code", markup.code_lang(F.coalesce("code_attrs", F.lit("")))).alias("lang"),
            "text",
            "place",
        ).alias("block"),
        F.when(in_cell, F.struct("table_seg", "row_seg", F.col("cell.seg").alias("cell_seg"), "block_no", "cell", "text")).alias("part"),
    )
    # The blocks of a page meet in its row, as they do again when it is rendered.
    of_page = found.groupBy(*keys).agg(F.collect_list(F.struct("block", "part")).alias("all"))
    return of_page.select(*keys, F.inline(_with_tables(F.col("all"))))


def _with_tables(found: Column) -> Column:
    """The blocks of a page, in any order, those of the cells of a table replaced by blocks of its rows."""
    part = lambda x: x.getField("part")
    block = lambda x: x.getField("block")
    plain = F.transform(F.filter(found, lambda x: part(x).isNull()), block)

    def of_cells(cells: Column) -> Column:
        own = lambda seg: F.filter(cells, lambda x: part(x).getField("table_seg") == seg)
        rows = lambda own: _table_rows(F.transform(own, part), block(F.get(own, F.lit(0))))
        tables = F.array_distinct(F.transform(cells, lambda x: part(x).getField("table_seg")))
        return F.flatten(F.transform(tables, lambda seg: let(own(seg), rows)))

    whole = F.concat(plain, let(F.filter(found, lambda x: part(x).isNotNull()), of_cells))
    return F.when(F.exists(found, lambda x: part(x).isNotNull()), whole).otherwise(F.transform(found, block))


def _span(attrs: Column, name: str, most: int) -> Column:
    """A span as a number of at least 1; what is no number is 1, and 0 (up to the end of the table) the most there can be."""
    digits = F.regexp_extract(attrs, rf"""(?i)(?:^|[\s"']){name}\s*=\s*["']?\s*(\d{{1,5}})\s*(?:["'\s]|$)""", 1)
    return let(digits, lambda d: F.when(d == "", 1).when(d.cast("int") == 0, most).otherwise(F.least(d.cast("int"), F.lit(most))))


def table_grid(cells: Column) -> Column:
    """Rows ``struct(seg, head, line)`` of the cells ``struct(row_seg, head, wide, tall, text)`` of one table, in order.

    A cell takes the first column that no cell of an earlier row spans. Its text stands in the first of its rows and
    columns, the others are empty. A row is a head if all its cells are ``th`` or stand in the head section.
    """
    blank = F.array().cast("array<string>")

    def row(seg: Column) -> Column:
        own = F.filter(cells, lambda c: c.getField("row_seg") == seg)
        return F.struct(seg.alias("seg"), F.forall(own, lambda c: c.getField("head")).alias("head"), own.alias("own"))

    def place(state: Column, item: Column) -> Column:
        """``left`` says for how many more rows a column is taken."""
        left = state.getField("left")
        taken = lambda i: F.coalesce(F.get(left, i), F.lit(0)) > 0

        def put(line: Column, cell: Column) -> Column:
            width = F.size(line.getField("texts"))
            free = F.get(F.filter(F.sequence(width, F.greatest(width, F.size(left))), lambda i: ~taken(i)), F.lit(0))
            gap = free - width
            wide, tall = cell.getField("wide"), cell.getField("tall")
            return F.struct(
                F.concat(line.getField("texts"), F.array_repeat(F.lit(""), gap), F.array(cell.getField("text")), F.array_repeat(F.lit(""), wide - 1)).alias("texts"),
                F.concat(line.getField("tall"), F.array_repeat(F.lit(0), gap), F.array_repeat(tall, wide)).alias("tall"))

        line = F.aggregate(item.getField("own"), F.struct(blank.alias("texts"), F.array().cast("array<int>").alias("tall")), put)

        def finish(line: Column) -> Column:
            more = F.greatest(F.size(left) - F.size(line.getField("texts")), F.lit(0))
            columns = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(line.getField("tall"))) - 1)
            rest = F.transform(columns, lambda i: F.greatest(F.coalesce(F.get(left, i), F.lit(0)), F.coalesce(F.get(line.getField("tall"), i), F.lit(0))) - 1)
            made = F.struct(item.getField("seg").alias("seg"), item.getField("head").alias("head"), F.concat(line.getField("texts"), F.array_repeat(F.lit(""), more)).alias("line"))
            return F.struct(F.concat(state.getField("rows"), F.array(made)).alias("rows"), rest.alias("left"))

        return let(line, finish)

    none = F.struct(F.array().cast("array<struct<seg:int,head:boolean,line:array<string>>>").alias("rows"), F.array().cast("array<int>").alias("left"))
    segs = F.array_distinct(F.transform(cells, lambda c: c.getField("row_seg")))
    return F.aggregate(F.transform(segs, row), none, place, lambda state: state.getField("rows"))


def _table_rows(parts: Column, block: Column) -> Column:
    """One ``table_row`` block for each row of a table; the first one holds the head and the rule below it.

    Texts of one cell are joined by blanks. A table without a head row gets an empty one, all rows have as many cells
    as the widest, and a bar in a text is escaped.
    """
    ordered = F.array_sort(F.transform(parts, lambda p: F.struct(p.getField("cell_seg").alias("cell_seg"), p.getField("block_no").alias("block_no"), p.alias("p"))))

    def cells(ordered: Column) -> Column:
        def whole(x: Column) -> Column:
            same = F.filter(ordered, lambda y: y.getField("cell_seg") == x.getField("cell_seg"))
            texts = F.filter(F.transform(same, lambda y: y.getField("p").getField("text")), lambda t: t != "")
            text = F.regexp_replace(F.regexp_replace(F.array_join(texts, " "), r"\s+", " "), r"(?<!\\)\|", r"\\|")
            cell = x.getField("p").getField("cell")
            return F.struct(x.getField("p").getField("row_seg").alias("row_seg"), *[cell.getField(c).alias(c) for c in ("head", "wide", "tall")], text.alias("text"))

        return F.transform(F.filter(ordered, lambda x: x.getField("cell_seg") == x.getField("block_no")), whole)

    def written(rows: Column) -> Column:
        wide = F.array_max(F.transform(rows, lambda r: F.size(r.getField("line"))))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), wide))

        def line(r: Column, i: Column) -> Column:
            texts = F.concat(r.getField("line"), F.array_repeat(F.lit(""), wide - F.size(r.getField("line"))))
            bars = F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))
            first = F.when(r.getField("head"), F.concat(bars, F.lit("\n"), rule)).otherwise(F.concat(F.lit("|"), F.repeat(F.lit("  |"), wide), F.lit("\n"), rule, F.lit("\n"), bars))
            return F.struct(
                r.getField("seg").alias("block_no"), block.getField("parent_block").alias("parent_block"), F.lit("table_row").alias("kind"),
                (i + 1).alias("level"), F.lit(None).cast("boolean").alias("ordered"), F.lit(None).cast("string").alias("lang"),
                F.when(i == 0, first).otherwise(bars).alias("text"), block.getField("place").alias("place"))

        return F.transform(rows, line)

    return let(let(let(ordered, cells), table_grid), written)


def group_list_runs(blocks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds ``run_id``, shared by adjacent items of one list, ``item_no`` within the list, ``continues`` and ``depth``.

    Items of a plain list are numbered by their list, also round a list nested in one of them. ``continues`` holds for
    the second and later blocks of one item.
    """
    order = Window.partitionBy(*keys).orderBy("block_no")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    this = F.struct("kind", "ordered", "parent_block")
    same = (F.col("kind") == "list_item") & this.eqNullSafe(F.lag(this).over(order))
    out = blocks.withColumns({"new_run": F.when(same, 0).otherwise(1), "nth": F.row_number().over(order)})
    out = out.withColumns(
        {
            "run_id": F.sum("new_run").over(running),
            "run_start": F.max(F.when(F.col("new_run") == 1, F.col("nth"))).over(running),
        }
    )
    in_list = Window.partitionBy(*keys, F.col("place.list_seg")).orderBy("place.item_seg")
    in_run = F.when(F.col("kind") == "list_item", F.col("nth") - F.col("run_start") + 1)
    first = F.row_number().over(Window.partitionBy(*keys, F.col("place.item_seg")).orderBy("block_no")) == 1
    placed = F.col("place").isNotNull()
    return out.withColumns(
        {
            "item_no": F.when(placed, F.dense_rank().over(in_list)).otherwise(in_run),
            "continues": placed & ~first,
            "depth": F.coalesce("place.depth", F.lit(0)),
        }
    ).drop("new_run", "nth", "run_start", "place")


def block_stats(blocks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Blocks and characters by page and kind."""
    return blocks.groupBy(*keys, "kind").agg(
        F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars")
    )


def render_block(fence_lang: bool = False) -> Column:
    """Markdown of one block row."""
    text = F.col("text")
    indent = F.repeat(F.lit(_INDENT), F.col("depth"))
    inner = F.concat(indent, F.lit(_INDENT))
    fence = F.concat(F.lit("```"), F.coalesce("lang", F.lit(""))) if fence_lang else F.lit("```")
    return (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(
            F.col("kind") == "list_item",
            F.concat(
                F.when(F.col("continues"), inner)
                .when(F.col("ordered"), F.concat(indent, F.col("item_no").cast("string"), F.lit(". ")))
                .otherwise(F.concat(indent, F.lit("* "))),
                F.when((F.col("depth") > 0) | F.col("continues"), F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), inner))).otherwise(text),
            ),
        )
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.regexp_replace(text, "\n", "\n> ")))
        .when(F.col("kind") == "code", F.concat(fence, F.lit("\n"), text, F.lit("\n```")))
        .when(F.col("kind") == "divider", "---")
        .otherwise(text)
    )


def render_markdown(blocks: DataFrame, keys: list[str] = KEYS, fence_lang: bool = False) -> DataFrame:
    """One document per page: blocks in order, one blank line between them, none inside a list run.

    ``blocks`` carries the columns of ``group_list_runs``.
    """
    text = blocks.where((F.col("kind") != "code") | (F.col("text") != ""))
    # The second and later items of a list follow their predecessor closely, and so does a list in an item.
    close = ((F.col("item_no") > 1) | (F.col("depth") > 0)) & ~F.col("continues")
    gap = F.when(close | ((F.col("kind") == "table_row") & (F.col("level") > 1)), "\n").otherwise("\n\n")
    pieces = text.select(
        *keys, F.struct("block_no", F.concat(gap, render_block(fence_lang)).alias("md")).alias("piece")
    )
    parts = F.transform(F.array_sort(F.collect_list("piece")), lambda p: p.getField("md"))
    return pieces.groupBy(*keys).agg(
        F.concat(F.regexp_replace(F.array_join(parts, ""), r"\A\n\n", ""), F.lit("\n")).alias("md")
    )
