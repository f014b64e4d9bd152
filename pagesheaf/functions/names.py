"""Output names and folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesheaf import fixed
from pagesheaf.functions.text import blank_to_null, collapse_space, strip
from pagesheaf.functions.urls import page_key

STEM = r"^(.+)(\.[^.]+)$"


def name_stem(name: Column) -> Column:
    """Name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(name, STEM, "$1")


def name_suffix(name: Column) -> Column:
    return F.regexp_extract(name, STEM, 2)


def sanitize_filename(c: Column) -> Column:
    """Trim, delete characters unfit for file names, then join white-space runs to one space."""
    return collapse_space(F.regexp_replace(strip(c), r'[\\/*?:"<>|]', ""))


def _safe_title(title: Column) -> Column:
    return F.substring(sanitize_filename(title), 1, fixed.NAME_LIMIT)


def output_name(title: Column, url: Column, default_stem: str = fixed.DEFAULT_STEM) -> Column:
    stem = F.coalesce(blank_to_null(_safe_title(title)), blank_to_null(page_key(url)), F.lit(default_stem))
    return F.concat(stem, F.lit(".md"))


def output_folder(
    base_dir: Column, title: Column, url: Column, ts: Column, default_stem: str = fixed.DEFAULT_STEM
) -> Column:
    stem = F.when(F.coalesce(title, F.lit("")) != "", _safe_title(title)).otherwise(
        F.coalesce(blank_to_null(page_key(url)), F.lit(default_stem))
    )
    folder = F.concat(stem, F.lit(" - "), F.date_format(ts, fixed.FOLDER_TIMESTAMP))
    return F.concat_ws("/", base_dir, folder)


def output_path(folder: Column, name: Column) -> Column:
    """File below the folder; an absolute name wins, without a folder the name stands."""
    return F.when(folder.isNull() | F.startswith(name, F.lit("/")), name).otherwise(
        F.concat_ws("/", folder, F.substring_index(name, "/", -1))
    )


def assets_folder(folder: Column, out_path: Column, assets_dir: Column) -> Column:
    """Folder of a page's assets; NULL where the given one is not a local path."""
    file_stem = name_stem(F.substring_index(out_path, "/", -1))
    default = F.concat_ws("/", folder, F.concat(file_stem, F.lit("_assets")))
    scheme = F.lower(F.regexp_extract(assets_dir, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (
        F.when(F.coalesce(assets_dir, F.lit("")) == "", default)
        .when(~scheme.isin("", "file"), F.lit(None).cast("string"))
        .when(F.startswith(assets_dir, F.lit("/")), assets_dir)
        .otherwise(F.concat_ws("/", folder, assets_dir))
    )


def safe_asset_name(name: Column) -> Column:
    """Stem limited to letters, digits, dot, underscore and dash; the suffix stays."""
    stem = F.regexp_replace(name_stem(name), "[^A-Za-z0-9._-]", "_")
    stem = F.regexp_replace(F.regexp_replace(stem, "_+", "_"), "^_|_$", "")
    return F.concat(F.coalesce(blank_to_null(stem), F.lit(fixed.DEFAULT_ASSET)), name_suffix(name))


def numbered_name(name: Column, number: Column, separator: str) -> Column:
    """``stem<separator><number>.suffix`` for a positive number, else the name itself."""
    return F.when(
        number > 0, F.concat(name_stem(name), F.lit(separator), number.cast("string"), name_suffix(name))
    ).otherwise(name)
