"""Expressions over the raw attribute text of one tag and over whole HTML strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions.text import (
    SPACE,
    apply_sql,
    blank_to_null,
    collapse_space,
    html_unescape,
    let,
    sql_string,
    strip,
)

# One attribute with its value; a quoted value is consumed whole, so text in it cannot pass for a name.
_ATTRIBUTE = r"""[^\s=/>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _attribute_hits(name: str) -> str:
    """SQL: the attributes of that name in the text ``a``."""
    return (
        f"filter(regexp_extract_all(a, {sql_string(_ATTRIBUTE)}, 0), "
        rf"p -> lower(regexp_extract(p, '^[^\\s=]+', 0)) = {sql_string(name)})"
    )


def attr(attrs: Column, name: str, decode: bool = True) -> Column:
    """Value of an attribute, '' if absent or without a value; of repeats the last counts."""
    value = sql_string(r"""(?s)^[^\s=]+\s*=\s*(["']?)(.*?)\1$""")
    raw = apply_sql(
        attrs,
        f"a -> CASE WHEN contains(lower(a), {sql_string(name)}) "
        f"THEN coalesce(regexp_extract(try_element_at({_attribute_hits(name)}, -1), {value}, 2), '') ELSE '' END",
    )
    return html_unescape(raw) if decode else raw


def has_attr(attrs: Column, name: str) -> Column:
    """The attribute is present, with or without a value."""
    return apply_sql(
        attrs, f"a -> contains(lower(a), {sql_string(name)}) AND size({_attribute_hits(name)}) > 0"
    )


def class_list(attrs: Column) -> Column:
    return F.split(strip(attr(attrs, "class", decode=False)), rf"{SPACE}+")


def has_word(classes: Column, word: str) -> Column:
    """``word`` stands in a class attribute between non-word characters."""
    pattern = rf"(^|\W){word}(\W|$)"
    return F.contains(classes, F.lit(word)) & classes.rlike(pattern)


def image_src(attrs: Column) -> Column:
    """First non-empty of src, data-src, data-original-src and the first address of srcset."""
    first_in_set = F.substring_index(strip(F.substring_index(attr(attrs, "srcset", decode=False), ",", 1)), " ", 1)
    return html_unescape(
        F.coalesce(
            *[blank_to_null(attr(attrs, a, decode=False)) for a in ("src", "data-src", "data-original-src")],
            first_in_set,
        )
    )


def is_emoji_img(attrs: Column) -> Column:
    def by_source(src: Column) -> Column:
        return F.contains(src, F.lit(fixed.EMOJI_SOURCE_PART)) | F.startswith(src, F.lit(fixed.EMOJI_SOURCE_PREFIX))

    return F.array_contains(class_list(attrs), fixed.EMOJI_CLASS) | let(
        strip(attr(attrs, "src", decode=False)), by_source
    )


def emoji_text(attrs: Column) -> Column:
    """Text an emoji image stands for, '' if its description starts with plain ASCII."""
    token = strip(F.substring_index(strip(attr(attrs, "alt")), " ", 1))
    return let(token, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), t).otherwise(F.lit("")))


def code_lang(attrs: Column) -> Column:
    """Language of a code element from its data attributes or classes, else NULL."""
    named = [blank_to_null(strip(attr(attrs, a, decode=False))) for a in fixed.LANGUAGE_ATTRIBUTES]
    pattern = r"(?i)^(?:language|lang)[-_](.+)$"
    from_class = F.get(F.filter(class_list(attrs), lambda c: c.rlike(pattern)), F.lit(0))
    return F.coalesce(*named, F.regexp_extract(from_class, pattern, 1))


# --- whole pages ----------------------------------------------------------------------------

# The inside of a tag up to its end; a quoted value is consumed whole. Nothing is tried twice.
_INSIDE = r"""(?>[^>"'=]+|=\s*(?:"[^"]*"|'[^']*')|["'=])*+"""
# Comments and raw text as they are, tags, and what stands between them.
_PARTS = (
    rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(fixed.RAW_TEXT_TAGS)})(?=[\s/>]){_INSIDE}>.*?(?:</\1\s*>|\z)"
    rf"|<[A-Za-z/!?]{_INSIDE}>|[^<]+|<"
)
# A tag whose first values are free of angle brackets and one is not.
_ANGLE_IN_VALUE = r"""<[A-Za-z](?>[^<>"'=]+|=\s*(?:"[^"<>]*"|'[^'<>]*')|=(?!\s*["'])|(?<!=)["'])*+=\s*(?:"[^"<>]*[<>]|'[^'<>]*[<>])"""


def plain_tags(html: Column) -> Column:
    """The page with angle brackets in quoted attribute values written as character references.

    Afterwards the first ``>`` ends a tag and every ``<`` in a tag begins it, which all patterns of this library rely
    on. Pages without such a value, nearly all, stay as they are after one look. A quote that never ends is no quote.
    """
    tag = r"(?is)^<(?!!--)[A-Za-z/!?].*>$"
    raw = rf"(?i)^<(?:{'|'.join(fixed.RAW_TEXT_TAGS)})[\s/>]"

    def one(part: Column) -> Column:
        inner = F.substr(part, F.lit(2), F.length(part) - 2)
        written = F.replace(F.replace(inner, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.when(part.rlike(tag) & ~part.rlike(raw), F.concat(F.lit("<"), written, F.lit(">"))).otherwise(part)

    parts = F.regexp_extract_all(html, F.lit(_PARTS), F.lit(0))
    return F.when(html.rlike(_ANGLE_IN_VALUE), F.array_join(F.transform(parts, one), "")).otherwise(html)


def remove_elements(
    html: Column, tags: list[str] = fixed.NONCONTENT_TAGS, replacement: str = "", comments: bool = False
) -> Column:
    """Remove elements with their content; void elements lose their tag.

    Comments come first, so a tag named in one starts nothing; they stay unless ``comments`` is set. An element
    whose content is raw text (script, style) and that is never closed lasts to the end of the page.
    """
    if not tags:
        return html
    parts = []
    for t in tags:
        opened = rf"{t}(?=[\s/>])[^>]*>"
        if t in fixed.VOID_TAGS:
            parts.append(opened)
        else:
            end = r"\z" if t in fixed.RAW_TEXT_TAGS else r"(?!)"
            parts.append(rf"{opened}.*?(?:</{t}\s*>|{end})")
    kept = "" if comments else "$1"
    return F.regexp_replace(html, rf"(?is)(<!--.*?(?:-->|\z))|<(?:{'|'.join(parts)})", kept + replacement)


def strip_tags(html: Column) -> Column:
    """Last-resort text: script and style bodies go first, then every tag."""
    out = html
    for tag in ("script", "style"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.regexp_replace(out, r"<[^>]+>", "")


def _element_text(html: Column, tag: str) -> Column:
    """Trimmed, decoded text of the first element of a kind, NULL if empty."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>", 1)
    return blank_to_null(strip(html_unescape(F.regexp_replace(inner, r"(?s)<!--.*?-->|<[^>]+>", ""))))


def extract_title(html: Column) -> Column:
    """First hit of title, first h1, h2, h3, og:title, first line of text."""
    html = plain_tags(html)
    og_tag = F.regexp_extract(
        html, r"""(?is)<meta\s(?=[^>]*\bproperty\s*=\s*["']?og:title["'\s/>])([^>]*)>""", 1
    )
    text = html_unescape(F.regexp_replace(remove_elements(html, ["script", "style"], "\n", comments=True), r"<[^>]+>", "\n"))
    lines = F.filter(
        F.transform(F.split(text, r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), strip),
        lambda line: line != "",
    )
    # Titles are looked for where they are elements: not in comments, scripts and styles.
    shown = remove_elements(html, ["script", "style"], comments=True)
    return F.coalesce(
        *[_element_text(shown, t) for t in ("title", "h1", "h2", "h3")],
        blank_to_null(strip(attr(og_tag, "content"))),
        F.get(lines, F.lit(0)),
    )


def extract_title_regex(html: Column) -> Column:
    """Title by two patterns only: title, else h1 without its tags. Entities stay."""
    title = r"(?is)<title>(.*?)</title>"
    heading = r"(?is)<h1[^>]*>(.*?)</h1>"
    return (
        F.when(html.rlike(title), strip(collapse_space(F.regexp_extract(html, title, 1))))
        .when(html.rlike(heading), strip(F.regexp_replace(F.regexp_extract(html, heading, 1), r"<[^>]+>", "")))
    )
