"""Normalising written Markdown. A document is one row, so none of this needs an exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions.text import html_unescape, let, rstrip, strip


def line_array(text: Column) -> Column:
    """Unified line ends, decoded references, lines trimmed at the right."""
    decoded = html_unescape(F.regexp_replace(text, "\r\n?", "\n"))
    return F.transform(F.split(decoded, "\n"), rstrip)


def md_lines(documents: DataFrame, text: str = "md", keys: list[str] = ["doc_id"]) -> DataFrame:
    """``keys, line_no, line``, lines counted from 0."""
    return documents.select(*keys, F.posexplode(line_array(F.col(text))).alias("line_no", "line"))


def is_placeholder_line(line: Column, phrases: list[str] = fixed.LINE_PLACEHOLDERS) -> Column:
    low = F.lower(strip(line))
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(low, F.lit(phrase.lower()))
    return hit


def drop_placeholder_lines(lines: DataFrame, phrases: list[str] = fixed.LINE_PLACEHOLDERS) -> DataFrame:
    """Lines without a leftover placeholder; blank lines stay."""
    return lines.where(~is_placeholder_line(F.col("line"), phrases))


def _collapse(text: Column, most: int) -> Column:
    """Blank runs longer than ``most`` become exactly ``most``. Blank lines are empty here.

    A run at the start of the text is preceded by no line end, a run at its end by one.
    """
    inner = F.regexp_replace(text, rf"(?<=[^\n])\n{{{most + 2},}}(?=[^\n])", "\n" * (most + 1))
    head = F.regexp_replace(inner, rf"\A\n{{{most + 1},}}(?=[^\n])", "\n" * most)
    tail = F.regexp_replace(head, rf"(?<=[^\n])\n{{{most + 1},}}\z", "\n" * most)
    return F.regexp_replace(tail, rf"\A\n{{{most},}}\z", "\n" * (most - 1))


def collapse_blank_runs(text: Column, most: int = 2) -> Column:
    """Blank runs of more than ``most`` lines become ``most``; the text ends with a line end."""
    blank_free = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(strip(x) == "", "").otherwise(x)), "\n")
    collapsed = _collapse(blank_free, most)
    return let(collapsed, lambda t: F.when(F.endswith(t, F.lit("\n")), t).otherwise(F.concat(t, F.lit("\n"))))


def normalize_text(text: Column, phrases: list[str] = fixed.LINE_PLACEHOLDERS) -> Column:
    kept = F.filter(line_array(text), lambda line: ~is_placeholder_line(line, phrases))
    return collapse_blank_runs(F.array_join(kept, "\n"))


def normalize_summary(
    documents: DataFrame, text: str = "md", keys: list[str] = ["doc_id"], phrases: list[str] = fixed.LINE_PLACEHOLDERS
) -> DataFrame:
    """``keys, status, original_sha256, normalized_sha256, bytes_written, normalized``."""
    source = documents.select(*keys, F.col(text).alias("original")).withColumn(
        "normalized", normalize_text(F.col("original"), phrases)
    )
    return source.select(
        *keys,
        F.when(F.col("original").isNull(), "utf8_error").otherwise("success").alias("status"),
        F.sha2("original", 256).alias("original_sha256"),
        F.sha2("normalized", 256).alias("normalized_sha256"),
        F.octet_length("normalized").cast("bigint").alias("bytes_written"),
        "normalized",
    )


def summary_json(summary: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """The summary without the text, as one JSON string per document."""
    fields = ["status", "original_sha256", "normalized_sha256", "bytes_written"]
    return summary.select(*keys, F.to_json(F.struct(*fields, F.lit("utf-8").alias("encoding"))).alias("summary"))
