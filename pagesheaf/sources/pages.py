"""Sources and sinks."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesheaf.schemas import PAGES
from pagesheaf.session import staged

# Tasks of a scan of files for each core. Spark counts 4 MB for opening a file, so small ones would be read by a task for every few.
SCAN_TASKS = 32


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages; only the three columns the operators use are read."""
    return spark.read.schema(PAGES).parquet(path)


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """Strict UTF-8 decoding as a status: adds ``text`` (NULL if invalid) and ``status``."""
    as_text = F.col(content).cast("string")
    valid = F.is_valid_utf8(as_text)
    return df.withColumn("text", F.when(valid, as_text)).withColumn(
        "status", F.when(F.col(content).isNull(), "missing").when(valid, "ok").otherwise("utf8_error")
    )


def scan_text_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, n_bytes, text, status`` of text files; a file that is not UTF-8 does not fail the job.

    With a ``pattern`` of file names, folders below ``path`` are read as well. However many files there are, they are read
    by ``SCAN_TASKS`` tasks for each core at most, one file after another.
    """
    reader = spark.read.format("binaryFile")
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    files = reader.load(path).coalesce(SCAN_TASKS * spark.sparkContext.defaultParallelism)
    return decode_text(files).select("path", F.col("length").alias("n_bytes"), "text", "status")


def quarantine(df: DataFrame, bad: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Split into good and bad rows; by default on ``status``."""
    failed = F.coalesce(F.col("status") != "ok", F.lit(True)) if bad is None else F.coalesce(bad, F.lit(True))
    return df.where(~failed), df.where(failed)


def write_markdown(markdown: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One row per document, replacing what is there."""
    writer = markdown.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _file_system(root: str):
    """File system and folder of an address; a path without a scheme is one that all machines share."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+://", root):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def _write_batches(root: str):
    """Writes the rows of a task, each to a hidden file that is then renamed, so that a repeated task does no harm."""

    def write(batches):
        files, base = _file_system(root)
        made: set[str] = set()
        for batch in batches:
            errors: list[str | None] = []
            for place, content, status in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "status"))):
                if status != "ok":
                    errors.append(None)
                    continue
                folder, _, name = f"{base}/{place}".rpartition("/")
                hidden = f"{folder}/.{uuid.uuid4().hex}"
                try:
                    if folder not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    with files.open_output_stream(hidden) as out:
                        out.write(content)
                    try:
                        files.move(hidden, f"{folder}/{name}")
                    except OSError:
                        files.delete_file(hidden)
                        raise
                    errors.append(None)
                except OSError as error:
                    errors.append(str(error))
            narrow = batch.select(["path", "n_bytes", "status"])
            failed = pa.array(["failed" if e else s for e, s in zip(errors, narrow.column("status").to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(
                [narrow.column("path"), narrow.column("n_bytes"), failed, pa.array(errors, pa.string())], ["path", "n_bytes", "status", "error"]
            )

    return write


def write_text_files(df: DataFrame, root: str, path: Column, content: Column, key: Column) -> DataFrame:
    """One file per row below ``root``, replacing what is there; returns ``path, n_bytes, status, error``, stored.

    Texts are written as UTF-8, binary contents as they are. The folder has to be one that all machines share. A row that
    cannot be written keeps its status and fails nothing: ``missing`` without a content or a path, ``outside`` if the path is absolute or
    climbs out of the folder, ``repeated`` if a row of a smaller ``key`` has the same path, ``failed`` with the file system's error, such as a
    name that is too long. Split them off by ``quarantine``. Files are renamed when they are whole.
    """
    rows = df.select(path.alias("path"), content.cast("binary").alias("content"), key.alias("key"))
    shared = rows.groupBy("path").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    status = (
        F.when(F.col("content").isNull() | (F.coalesce("path", F.lit("")) == ""), "missing")
        .when(F.col("path").rlike(r"^/|(^|/)\.\.?(/|$)|/$|\x00"), "outside")
        .when(F.col("first").isNotNull() & (F.col("key") != F.col("first")), "repeated")
        .otherwise("ok")
    )
    marked = rows.join(shared, "path", "left").select(
        "path", "content", F.octet_length("content").cast("bigint").alias("n_bytes"), status.alias("status")
    )
    return staged(marked.mapInArrow(_write_batches(root), "path string, n_bytes bigint, status string, error string"), "written-files")


def write_side_html(pages: DataFrame, path: str) -> None:
    """Captured pages next to the output, for diagnosis."""
    pages.select("page_id", "html").write.mode("overwrite").parquet(path)


def write_asset_manifest(assets: DataFrame, path: str) -> None:
    assets.write.mode("overwrite").parquet(path)
