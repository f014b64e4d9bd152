"""Address expressions: keys, joining, quoting and asset names."""

from __future__ import annotations

import json
import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions.text import blank_to_null, let

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?"
_HEX_ID = r"(?i)[0-9a-f]{32}"


def url_path(url: Column) -> Column:
    """Path of an address without query, fragment and last-segment parameters."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), _ORIGIN, "")
    return F.regexp_replace(path, r";[^/]*$", "")


def _last_dash_piece(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "-"), -1)


def page_key(url: Column) -> Column:
    """Piece of the path after the last dash."""
    return F.coalesce(_last_dash_piece(url), F.lit(""))


def page_hex_id(url: Column) -> Column:
    """Lower-case 32-digit hexadecimal id of an address, '' if it has none."""
    tail = F.regexp_extract(_last_dash_piece(url), rf"^({_HEX_ID})$", 1)
    anywhere = F.regexp_extract(url_path(url), f"({_HEX_ID})", 1)
    return F.coalesce(F.lower(F.coalesce(blank_to_null(tail), anywhere)), F.lit(""))


def is_page_host(url: Column, host_regex: str = fixed.PAGE_HOST_REGEX) -> Column:
    return url.rlike(host_regex)


def is_fetchable_href(href: Column, resolved: Column, host_regex: str = fixed.PAGE_HOST_REGEX) -> Column:
    """A non-empty href that names a file rather than a fragment, a mail address, a script or a page."""
    return (href != "") & ~href.rlike("^(#|mailto:|javascript:)") & ~is_page_host(resolved, host_regex)


def _remove_dot_segments(path: Column) -> Column:
    def step(acc: Column, segment: Column) -> Column:
        shorter = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(segment == "..", shorter).when(segment == ".", acc).otherwise(F.concat(acc, F.array(segment)))
        )

    def walk(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        closing = F.element_at(parts, -1).isin(".", "..")
        return F.array_join(F.when(closing, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")

    dotted = path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(dotted, let(F.split(path, "/"), walk)).otherwise(path)


def resolve_url(base: Column, ref: Column) -> Column:
    """Join a reference to a base address (RFC 3986)."""
    origin = F.regexp_extract(base, _ORIGIN, 0)
    scheme = F.regexp_extract(base, _ORIGIN, 1)
    base_path = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), _ORIGIN, "")
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    ref_path = F.regexp_extract(ref, r"^[^?#]*", 0)
    ref_tail = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    ref_tail = F.regexp_replace(ref_tail, r"^\?#", "#")
    ref_tail = F.regexp_replace(ref_tail, r"[?#]$", "")
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    # Empty segments inside a merged relative path are dropped.
    merged = F.regexp_replace(F.concat(folder, ref_path), r"(?<=.)/{2,}", "/")
    absolute = F.when(F.startswith(ref_path, F.lit("/")), ref_path).otherwise(merged)

    def with_path(path: Column) -> Column:
        return F.concat(origin, F.when(path == "", F.lit("/")).when(
            ~F.startswith(path, F.lit("/")) & (F.regexp_extract(base, _ORIGIN, 2) != ""), F.concat(F.lit("/"), path)
        ).otherwise(path), ref_tail)

    return (
        F.when(F.coalesce(base, F.lit("")) == "", ref)
        .when(ref == "", base)
        .when(ref.rlike(_SCHEME), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, ref))
        .when(ref.rlike(r"^\??(#|$)"), F.concat(origin, base_path, base_query, ref_tail))
        .when(F.startswith(ref, F.lit("?")), F.concat(origin, base_path, ref_tail))
        .otherwise(let(_remove_dot_segments(absolute), with_path))
    )


def quote_path(c: Column) -> Column:
    """Percent-encode everything but letters, digits, ``_.-~`` and the slash."""
    form = F.url_encode(c)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def file_name_from_url(url: Column) -> Column:
    """Last path segment without the query; characters unfit for file names become underscores."""
    bare = F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")
    last = F.coalesce(blank_to_null(F.substring_index(bare, "/", -1)), F.lit(fixed.DEFAULT_RESOURCE))
    return F.regexp_replace(last, r'[\\/:*?"<>|]', "_")


def _mime_suffixes() -> str:
    table = mimetypes.MimeTypes(filenames=())
    known = {m for group in table.types_map for m in group.values()}
    return json.dumps({m: table.guess_extension(m) for m in sorted(known) if table.guess_extension(m)})


_SUFFIXES = _mime_suffixes()


def data_uri_parts(uri: Column) -> Column:
    """``struct(name, content)`` of a data URI; ``content`` is NULL where it cannot be decoded."""
    header = F.substring_index(uri, ",", 1)
    body = F.regexp_extract(uri, r"(?s)^[^,]*,(.*)$", 1)
    mime = F.regexp_extract(header, r"data:(.*?);base64", 1)
    suffix = F.coalesce(
        F.element_at(F.from_json(F.lit(_SUFFIXES), "map<string,string>"), mime), F.lit(fixed.EMBEDDED_SUFFIX)
    )
    has_body = F.contains(uri, F.lit(","))
    return F.struct(
        F.concat(F.lit(fixed.EMBEDDED_STEM), suffix).alias("name"),
        F.when(has_body, F.try_to_binary(body, F.lit("base64"))).alias("content"),
    )


def is_data_uri(url: Column) -> Column:
    return F.startswith(url, F.lit("data:"))


def asset_name(url: Column) -> Column:
    """Name an asset is saved under before clashes are resolved; NULL if it cannot be saved."""
    parts = data_uri_parts(url)
    return F.when(
        is_data_uri(url), F.when(parts.getField("content").isNotNull(), parts.getField("name"))
    ).otherwise(file_name_from_url(url))


def asset_rel_path(folder: Column, name: Column) -> Column:
    return quote_path(F.concat_ws("/", folder, name))
