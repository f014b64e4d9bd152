"""Code blocks that arrive as many inline elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions import markup
from pagesheaf.functions.text import code_text, strip
from pagesheaf.operators.tokens import KEYS, in_order, inside_elements, pair_tags, upto_here, whole_group
from pagesheaf.session import staged


def _is_code_element() -> Column:
    classes = markup.class_list(F.lower(F.col("attrs")))
    both = F.lit(True)
    for word in fixed.CODE_CLASSES:
        both = both & F.array_contains(classes, word)
    return F.contains(F.lower("attrs"), F.lit(fixed.CODE_CLASSES[0])) & both


def _collect_texts(inside: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, pos, attrs, parts`` of the tokens of each group, first token first."""
    text = F.when(F.col("kind") == "text", F.col("text")).when(
        (F.col("kind") == "open") & (F.col("tag") == "br"), "\n"
    )
    part = F.when(text.isNotNull(), F.struct("pos", text.alias("text")))
    return inside.groupBy(*groups).agg(
        F.min("pos").alias("pos"),
        F.min_by("attrs", "pos").alias("attrs"),
        F.transform(F.array_sort(F.collect_list(part)), lambda p: p.getField("text")).alias("parts"),
    )


def _marked_elements(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of the elements that carry both code classes and hold nothing preformatted.

    The content decides first; of nested elements that pass, the outermost counts. The element's own tag isn't its content.
    """
    code = (F.col("kind") == "open") & F.col("tag").isin("pre", "code")
    counted = tokens.withColumn("codes", F.sum(code.cast("int")).over(upto_here(keys)))
    counted = counted.withColumn("all_codes", F.max("codes").over(whole_group(keys)))
    bare = F.coalesce(F.col("end.codes"), F.col("all_codes")) == F.col("codes")
    inside = inside_elements(counted, _is_code_element() & bare, keys, ("codes",))
    first = F.col("starts") & (F.col("around") == 1)
    numbered = inside.withColumn("nth", F.sum(first.cast("int")).over(upto_here(keys)))
    return _collect_texts(numbered, [*keys, "nth"]).drop("nth")


def _many_span_elements(tokens: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Innermost elements with at least ``least`` spans and no preformatted part inside."""
    run = upto_here(keys)
    opens = F.col("kind") == "open"
    counted = pair_tags(tokens, keys).withColumns(
        {
            "spans": F.sum((opens & (F.col("tag") == "span")).cast("int")).over(run),
            "codes": F.sum((opens & F.col("tag").isin("pre", "code")).cast("int")).over(run),
        }
    ).where(F.col("step") != 0)
    at_open = F.lag(F.struct("pos", "spans", "codes", "attrs")).over(in_order([*keys, "tag", "lvl"]))
    closed = counted.withColumn("o", at_open).where(
        (F.col("step") == -1) & (F.col("spans") - F.col("o.spans") >= least) & (F.col("codes") == F.col("o.codes"))
        & ~F.col("tag").isin("pre", "code")
    )
    by_end = Window.partitionBy(*keys).orderBy("end")
    return (
        closed.select(*keys, F.col("o.pos").alias("start"), F.col("pos").alias("end"), "tag", F.col("o.attrs").alias("attrs"))
        .withColumn("inner", F.lag("start").over(by_end))
        .where(F.col("inner").isNull() | (F.col("inner") < F.col("start")))
        .drop("inner")
    )


def _text_in_spans(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Texts and inner tags of disjoint spans."""
    starts = spans.select(*keys, F.col("start").alias("pos"), F.col("end").alias("span_end"))
    joined = tokens.join(starts, [*keys, "pos"], "left")
    mark = F.when(F.col("span_end").isNotNull(), F.struct(F.col("pos").alias("start"), "span_end"))
    inside = joined.withColumn("span", F.last(mark, ignorenulls=True).over(upto_here(keys))).where(
        F.col("pos") <= F.col("span.span_end")
    )
    return _collect_texts(inside.withColumn("nth", F.col("span.start")), [*keys, "nth"]).drop("nth")


def code_blocks(
    tokens: DataFrame, keys: list[str] = KEYS, span_fallback: bool = False, least_spans: int = 4, **cleanup
) -> DataFrame:
    """``keys, pos, lang, text`` of code elements that hold no preformatted element themselves.

    An element inside one that holds such an element is a candidate of its own. ``span_fallback`` also takes, on pages without a code element, the innermost elements with
    many spans.
    """
    found = _marked_elements(tokens, keys)
    if span_fallback:
        # Read three times below, and small beside the tokens it comes from.
        found = staged(found, "marked-code")
        loose = _many_span_elements(tokens, keys, least_spans)
        others = tokens.join(found.select(*keys).distinct(), keys, "left_anti")
        loose = loose.join(found.select(*keys).distinct(), keys, "left_anti")
        found = found.unionByName(_text_in_spans(others, loose, keys))
    equals = F.exists("parts", lambda p: strip(p) == "=")
    return found.select(
        *keys,
        "pos",
        markup.code_lang(F.coalesce("attrs", F.lit(""))).alias("lang"),
        code_text(F.array_join("parts", ""), equals, **cleanup).alias("text"),
    )


def code_blocks_regex(pages: DataFrame, **cleanup) -> DataFrame:
    """Code blocks by pattern alone: ``page_id, pos, lang, text``, one per matching ``div``."""
    whole = r"""(?is)<div[^>]*class=["'][^"']*["'][^>]*>.*?</div>"""
    candidates = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(whole), F.lit(0))).alias("pos", "div"))
    div = F.col("div")
    classes = F.regexp_extract(div, r"""(?is)^<div[^>]*class=["']([^"']*)["']""", 1)
    inner = F.regexp_extract(div, r"""(?is)^<div[^>]*class=["'][^"']*["'][^>]*>(.*?)</div>$""", 1)
    hits = candidates.withColumns({"classes": classes, "inner": inner}).where(
        F.col("classes").rlike("(?i)" + "|".join(fixed.CODE_CLASSES)) & ~F.col("inner").rlike(r"(?i)<\s*(?:pre|code)\b")
    )
    text = F.regexp_replace("inner", r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, r"<\s*/?\s*(?:span|div|code|pre)[^>]*>", "")
    by_attr = F.regexp_extract(div, r"""(?i)data-(?:language|lang|block-language)=["']([^"']+)["']""", 1)
    by_class = F.regexp_extract("classes", r"(?i)(?:language|lang)[-_](\w+)", 1)
    equals = div.rlike(r"(?i)<span[^>]*>\s*=\s*</span>")
    return hits.select(
        "page_id", "pos",
        F.coalesce(F.nullif(by_attr, F.lit("")), F.nullif(by_class, F.lit(""))).alias("lang"),
        code_text(text, equals, **cleanup).alias("text"),
    )
