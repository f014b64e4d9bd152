"""Traces of content that had not loaded.

Every pass runs inside the page's row, so finding, ordering and de-duplicating occurrences needs no
exchange. A match and its surroundings come from one pattern: a lookahead finds the place cheaply,
and only there a bounded lookbehind captures what stands before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup
from pagesheaf.functions.text import SPACE, dedup_first, let, literal_pattern, strip

_N = fixed.CONTEXT_CHARS
# The fixed-length case comes first: it is tried once, the other only close to the start of the text.
_BEFORE = rf"(?:(?<=((?s:.{{{_N}}})))|(?<=\A((?s:.{{0,{_N - 1}}}))))"
_AFTER = rf"(?=((?s:.{{0,{_N}}})))"
_ROW = "array<struct<pass:int,snippet:string,match_type:string,context:string>>"


# Noncharacters, which no text may contain, set matches off for one split.
_MATCH, _PART = "\ufdd0", "\ufdd1"


def _matches(text: Column, pattern: str, flags: str = "", probe: str | None = None) -> Column:
    """Array of ``struct(before, found, after)`` for every match of the pattern, in one scan.

    ``probe`` is a cheap test, free of groups, for the places where a match may start.
    """
    groups = re.compile(pattern).groups
    skipped = groups if probe is None else 0
    whole = f"{flags}(?={pattern if probe is None else probe}){_BEFORE}{pattern}{_AFTER}"
    before = f"${skipped + 1}${skipped + 2}"
    found = f"{_MATCH}{before}{_PART}$0{_PART}${skipped + groups + 3}{_MATCH}"
    pieces = F.filter(F.split(F.regexp_replace(text, whole, found), _MATCH), lambda p, i: i % 2 == 1)

    def fields(piece: Column) -> Column:
        parts = F.split(piece, _PART)
        return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("before", "found", "after"))])

    return F.transform(pieces, fields)


def _context(m: Column) -> Column:
    return F.concat(m.getField("before"), m.getField("found"), m.getField("after"))


def _row(number: int, snippet: Column, kind: str, context: Column) -> Column:
    return F.struct(
        F.lit(number).alias("pass"), snippet.alias("snippet"), F.lit(kind).alias("match_type"), context.alias("context")
    )


def _has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(re.escape(w).replace(r"\-", "-") for w in words))


def _when_likely(html: Column, words: list[str], rows: Column) -> Column:
    """Skip the pass on pages that contain none of the words at all."""
    return F.when(_has_any(F.lower(html), words), rows).otherwise(F.array().cast(_ROW))


def class_pass(html: Column) -> Column:
    hits = _matches(html, r"""class=["'][^"']+["']""", "(?i)", "class=")

    def rows(m: Column) -> Column:
        value = F.regexp_extract(m.getField("found"), r"""(?s)=["'](.*)["']$""", 1)
        words = F.filter(F.split(strip(value), rf"{SPACE}+"), lambda c: _has_any(F.lower(c), fixed.PLACEHOLDER_CLASS_KEYWORDS))
        return F.transform(words, lambda c: _row(1, F.concat(F.lit("."), c), "class", _context(m)))

    return _when_likely(html, fixed.PLACEHOLDER_CLASS_KEYWORDS, F.flatten(F.transform(hits, rows)))


def attribute_pass(html: Column) -> Column:
    # A match starts where a name starts; without the lookbehind every letter would be tried.
    name = r"[a-zA-Z0-9_\-:]"
    hits = _matches(html, rf"""{name}++=["'][^"']*["']""", probe=rf"(?<!{name}){name}++=")
    parts = r"""(?s)^([^=]+)=["'](.*)["']$"""

    def wanted(m: Column) -> Column:
        low = F.lower(m.getField("found"))
        name = F.regexp_extract(low, parts, 1)
        return (
            name.isin(*fixed.PLACEHOLDER_ATTRIBUTE_NAMES)
            | _has_any(name, fixed.PLACEHOLDER_ATTRIBUTE_KEYWORDS)
            | _has_any(F.regexp_extract(low, parts, 2), fixed.PLACEHOLDER_ATTRIBUTE_KEYWORDS)
        )

    def row(m: Column) -> Column:
        found = m.getField("found")
        snippet = F.concat(F.regexp_extract(found, parts, 1), F.lit('="'), F.regexp_extract(found, parts, 2), F.lit('"'))
        return _row(2, snippet, "attribute", _context(m))

    return _when_likely(html, fixed.PLACEHOLDER_ATTRIBUTE_KEYWORDS, F.transform(F.filter(hits, wanted), row))


def text_pass(html: Column, patterns: list[str], use_regex: bool, ignore_tags: list[str]) -> Column:
    bare = html
    for tag in ignore_tags:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    flags = "(?iU)"

    def one(text: Column, phrase: str) -> Column:
        pattern = phrase if use_regex else literal_pattern(phrase)[len(flags):]

        def row(m: Column) -> Column:
            if use_regex:
                return _row(3, m.getField("found"), "regex", strip(_context(m)))
            return _row(3, F.lit(phrase), "text", strip(_context(m)))

        rows = F.transform(_matches(text, pattern, flags), row)
        return F.when(text.rlike(flags + pattern), rows).otherwise(F.array().cast(_ROW))

    content = F.regexp_replace(bare, "<[^>]+>", " ")
    return let(content, lambda text: F.concat(*[one(text, phrase) for phrase in patterns]))


def placeholder_occurrences(
    html: Column,
    patterns: list[str] | None = None,
    use_regex: bool = True,
    ignore_tags: list[str] = fixed.PLACEHOLDER_IGNORE_TAGS,
    exclude_attrs: list[str] | None = None,
) -> Column:
    """Array of occurrences of one page, the first per snippet and match type."""
    if patterns is None:
        patterns = fixed.PLACEHOLDER_REGEX_PATTERNS if use_regex else fixed.PLACEHOLDER_PATTERNS
    attributes = attribute_pass(html)
    if exclude_attrs:
        attributes = F.filter(
            attributes, lambda r: ~F.lower(F.substring_index(r.getField("snippet"), "=", 1)).isin(*exclude_attrs)
        )
    found = F.concat(class_pass(html), attributes, text_pass(html, patterns, use_regex, ignore_tags))
    numbered = F.transform(
        found,
        lambda r, i: F.struct(
            F.concat(r.getField("match_type"), F.lit(":"), r.getField("snippet")).alias("same"),
            i.alias("pos"),
            r.alias("row"),
        ),
    )
    return F.coalesce(dedup_first(numbered, "same", "pos"), F.array().cast(f"array<struct<same:string,pos:int,row:{_ROW[6:-1]}>>"))


def placeholders_html(pages: DataFrame, **options) -> DataFrame:
    """``page_id, pass, pos, selector_or_snippet, match_type, context`` of every page."""
    hits = pages.select("page_id", F.explode(placeholder_occurrences(F.col("html"), **options)).alias("hit"))
    return hits.select(
        "page_id",
        "hit.row.pass",
        "hit.pos",
        F.col("hit.row.snippet").alias("selector_or_snippet"),
        "hit.row.match_type",
        "hit.row.context",
    )


def has_placeholders(html: Column, **options) -> Column:
    return F.size(placeholder_occurrences(html, **options)) > 0


def dedup_occurrences(placeholders: DataFrame) -> DataFrame:
    """First occurrence per page, snippet and match type, of a table of occurrences."""
    same = Window.partitionBy("page_id", "selector_or_snippet", "match_type").orderBy("pass", "pos")
    return placeholders.withColumn("nth", F.row_number().over(same)).where(F.col("nth") == 1).drop("nth")


def dedup_matches_ci(matches: DataFrame, keys: list[str], match: str = "match", pos: str = "pos") -> DataFrame:
    """First spelling per key and lower-cased match."""
    same = Window.partitionBy(*keys, F.lower(match)).orderBy(pos)
    return matches.withColumn("nth", F.row_number().over(same)).where(F.col("nth") == 1).drop("nth")


def placeholder_summary(pages: DataFrame, **options) -> DataFrame:
    """Occurrences by match type for every page, pages without any included. Needs no exchange."""
    found = pages.select("page_id", placeholder_occurrences(F.col("html"), **options).alias("found"))

    def count(kind: str) -> Column:
        hits = F.filter("found", lambda r: r.getField("row").getField("match_type") == kind)
        return F.size(hits).alias(f"n_{kind}")

    counts = [count(k) for k in ("class", "attribute", "text", "regex")]
    return found.select("page_id", *counts, (F.size("found") > 0).alias("has_placeholders"))


def pending_blocks(tokens: DataFrame) -> DataFrame:
    """Blocks still loading: ``page_id, pos, pending, kind_rank``; shimmer ranks before unknown."""
    kinds = F.array(
        F.struct(F.lit(0).alias("kind_rank"), F.lit("shimmer").alias("pending"), F.lit(fixed.SHIMMER_CLASS).alias("cls")),
        F.struct(F.lit(1).alias("kind_rank"), F.lit("unknown").alias("pending"), F.lit(fixed.UNKNOWN_BLOCK_CLASS).alias("cls")),
    )
    divs = tokens.where(
        (F.col("kind") == "open") & (F.col("tag") == "div")
        & F.col("attrs").rlike(f"{fixed.SHIMMER_CLASS}|{fixed.UNKNOWN_BLOCK_CLASS}")
    )
    classes = markup.class_list(F.col("attrs"))
    hits = divs.select(
        "page_id", "pos", F.explode(F.filter(kinds, lambda k: F.array_contains(classes, k.getField("cls")))).alias("k")
    )
    return hits.select("page_id", "pos", "k.pending", "k.kind_rank")


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key. The rank filter is applied before the exchange as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("nth", rank).where(F.col("nth") <= n)


def first_n_pending(pending: DataFrame, n: int = fixed.PENDING_PER_ROUND) -> DataFrame:
    return first_n(pending, ["page_id"], ["kind_rank", "pos"], n)


def first_n_occurrences(placeholders: DataFrame, n: int = fixed.PHRASE_PER_ROUND) -> DataFrame:
    return first_n(placeholders, ["page_id", "selector_or_snippet"], ["pass", "pos"], n)
