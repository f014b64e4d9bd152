"""Text expressions. All are built-in column expressions; none leaves the JVM."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesheaf import fixed

# Unicode white space plus the four separators that Python's str.strip also removes. Spelled out,
# because a plain class is cheaper than a Unicode property and serves the trim functions too: single
# Latin characters become one bit test, and a range test keeps other text from the rest.
_NOT_BLANK = (
    r"\t\n\x{0b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{85}\x{a0}"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
SPACE = rf"[ {_NOT_BLANK}]"
_SPACE_CHARS = "".join(
    chr(i)
    for i in [
        0x20, *range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
        0x202F, 0x205F, 0x3000,
    ]
)
# Runs that are not already one blank; a single blank between words costs no replacement.
_SPACE_RUN = rf" {SPACE}+|[{_NOT_BLANK}]{SPACE}*"
NBSP = " "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE_RUN, " ")


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def dedup_first(items: Column, key: str, order: str) -> Column:
    """Keep the first struct per ``key`` (by ``order``) of an array, result sorted by ``order``.

    Sorting makes equal keys neighbours, so the cost is n log n and not n squared.
    """

    def pick(rows: Column) -> Column:
        return F.filter(
            rows,
            lambda x, i: (i == 0)
            | ~F.get(rows, i - 1).getField("sort_key").eqNullSafe(x.getField("sort_key")),
        )

    keyed = F.array_sort(
        F.transform(
            items,
            lambda x: F.struct(x.getField(key).alias("sort_key"), x.getField(order).alias("rank"), x.alias("row")),
        )
    )
    by_order = F.array_sort(
        F.transform(let(keyed, pick), lambda x: F.struct(x.getField("rank").alias("rank"), x.getField("row").alias("row")))
    )
    return F.transform(by_order, lambda x: x.getField("row"))


# --- character references -------------------------------------------------------------------

_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_COMMON = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": NBSP, "copy;": "©", "middot;": "·", "#39;": "'"}
# The table as one string for each first letter, so that a look-up reads a small part of it: every entry is a
# separator, the name, a divider, the characters.
_ENTRY, _GIVES = "\x1e", "\x1f"
_NAMED = [
    "".join(f"{_ENTRY}{n}{_GIVES}{c}" for n, c in sorted(html.entities.html5.items()) if n[0] == chr(code)) + _ENTRY
    for code in range(ord("A"), ord("z") + 1)
]
_LEGACY = "^(" + "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)) + ")"


def _windows_character(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def sql_string(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def apply_sql(c: Column, body: str) -> Column:
    """Apply a SQL lambda to a column. Large expressions are built much faster as SQL text."""
    return F.get(F.call_function("transform", F.array(c), F.expr(body)), F.lit(0))


def _unescape_sql() -> str:
    windows = sql_string("".join(_windows_character(i) for i in range(0x80, 0xA0)))
    # Numeric references, by the rules of the HTML standard.
    code = """CASE WHEN substr(b, 2, 1) IN ('x', 'X')
        THEN try_cast(conv(regexp_extract(b, '^#[xX]0*([0-9a-fA-F]{1,7});?$', 1), 16, 10) AS BIGINT)
        ELSE try_cast(regexp_extract(b, '^#([0-9]+)', 1) AS BIGINT) END"""
    character = f"""CASE WHEN n BETWEEN 128 AND 159 THEN substr({windows}, CAST(n - 127 AS INT), 1)
        WHEN n IS NULL OR n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN '\ufffd'
        WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127
          OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN ''
        ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"""
    common = " ".join(
        f"WHEN b = {sql_string(n)} THEN concat({sql_string(c)}, substr(p, {len(n) + 1}))" for n, c in _COMMON.items()
    )
    # A known name is used whole, otherwise the longest name that may lack its semicolon.
    named = f"""get(transform(array(get(tables, ascii(b) - {ord("A")})), names -> transform(filter(array(b, regexp_extract(b, '{_LEGACY}', 1)), m -> instr(names, concat('{_ENTRY}', m, '{_GIVES}')) > 0),
        m -> concat(substring_index(substr(names, instr(names, concat('{_ENTRY}', m, '{_GIVES}')) + length(m) + 2, 8), '{_ENTRY}', 1),
                    substr(b, length(m) + 1)))), 0)"""
    piece = f"""CASE WHEN b = '' THEN concat('&', p) {common}
        WHEN startswith(b, '#') THEN concat(get(transform(array({code}), n -> {character}), 0), substr(p, length(b) + 1))
        ELSE coalesce(concat(get({named}, 0), substr(p, length(b) + 1)), concat('&', p)) END"""
    return f"""t -> CASE WHEN instr(t, '&') = 0 THEN t ELSE get(transform(array(split(t, '&')), ps ->
        concat(ps[0], array_join(get(transform(array(array({', '.join(map(sql_string, _NAMED))})), tables ->
            transform(slice(ps, 2, greatest(size(ps) - 1, 0)), p ->
                get(transform(array(regexp_extract(p, {sql_string(_REFERENCE)}, 1)), b -> {piece}), 0))), 0), ''))), 0) END"""


_UNESCAPE = _unescape_sql()


def html_unescape(c: Column) -> Column:
    """Decode named and numeric character references, once.

    Text without an ampersand is returned at the cost of one scan.
    """
    return apply_sql(c, _UNESCAPE)


# --- placeholders in text -------------------------------------------------------------------


def case_free(pattern: str) -> str:
    """Case-insensitive pattern with Unicode word and space classes."""
    return f"(?iU){pattern}"


def literal_pattern(phrase: str) -> str:
    return case_free(re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", phrase))


def is_placeholder_literal(text: Column, patterns: list[str] = fixed.PLACEHOLDER_PATTERNS) -> Column:
    """Any phrase is a case-insensitive substring."""
    low = F.lower(text)
    found = F.lit(False)
    for phrase in patterns:
        found = found | F.contains(low, F.lit(phrase.lower()))
    return found


def is_loading_phrase(text: Column) -> Column:
    return let(
        F.lower(strip(text)),
        lambda low: low.rlike("^(carregando|loading)") & low.rlike("plain|codigo|loading code"),
    )


def strip_placeholder_text(
    text: Column,
    patterns: list[str] = fixed.PLACEHOLDER_PATTERNS,
    regex_patterns: list[str] = fixed.PLACEHOLDER_REGEX_PATTERNS,
    use_regex: bool = True,
) -> Column:
    """Cut regex matches, then literal phrases; non-breaking spaces become spaces."""
    return F.replace(_cut_placeholders(text, patterns, regex_patterns, use_regex), F.lit(NBSP), F.lit(" "))


def _cut_placeholders(text: Column, patterns, regex_patterns, use_regex: bool) -> Column:
    out = text
    if use_regex:
        for pattern in regex_patterns:
            out = F.regexp_replace(out, case_free(pattern), "")
    for phrase in patterns:
        out = F.regexp_replace(out, literal_pattern(phrase), "")
    return out


def placeholder_matches(
    text: Column,
    patterns: list[str] | None = None,
    use_regex: bool = True,
) -> Column:
    """``struct(has, matches)``: pattern-major matches, one per spelling regardless of case."""
    if patterns is None:
        patterns = fixed.PLACEHOLDER_REGEX_PATTERNS if use_regex else fixed.PLACEHOLDER_PATTERNS
    if use_regex:
        found = F.flatten(
            F.array(*[F.regexp_extract_all(text, F.lit(case_free(p)), F.lit(0)) for p in patterns])
        )
    else:
        low = F.lower(text)
        found = F.filter(
            string_array(patterns), lambda p: F.contains(low, F.lower(p))
        )
    rows = F.transform(
        F.coalesce(found, F.array().cast("array<string>")),
        lambda m, i: F.struct(m.alias("m"), F.lower(m).alias("low"), i.alias("i")),
    )
    kept = F.transform(dedup_first(rows, "low", "i"), lambda x: x.getField("m"))
    return let(kept, lambda m: F.struct((F.size(m) > 0).alias("has"), m.alias("matches")))


# --- code text ------------------------------------------------------------------------------


def code_text(
    text: Column,
    equals_part: Column,
    patterns: list[str] = fixed.PLACEHOLDER_PATTERNS,
    regex_patterns: list[str] = fixed.PLACEHOLDER_REGEX_PATTERNS,
    use_regex: bool = True,
) -> Column:
    """Clean the text of a code block; '' when nothing but a placeholder is left.

    ``equals_part`` tells whether one text node of the block is exactly an equals sign.
    """

    def clean(t: Column) -> Column:
        def result(cut: Column) -> Column:
            spaced = F.when(equals_part, F.regexp_replace(cut, rf"{SPACE}*={SPACE}*", " = ")).otherwise(cut)
            return F.when((strip(cut) == "") | is_loading_phrase(t), F.lit("")).otherwise(spaced)

        return let(_cut_placeholders(t, patterns, regex_patterns, use_regex), result)

    return let(F.replace(html_unescape(text), F.lit(NBSP), F.lit(" ")), clean)
