"""The training-data pipeline: quality, language, near copies, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. What a
stage returns is written to Parquet and read again as the next one's ``docs``. Null texts count as empty, rows that are
repeated in the input are judged each for itself (the near-copy stage keeps one of them), extra columns travel along
untouched, and an empty table stays empty. The stages let the session send smaller batches of texts to Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesheaf.llm.common import small_batches, stored, table
from pagesheaf.llm.language import language_of, reference_texts
from pagesheaf.llm.mixing import mixed_documents
from pagesheaf.llm.packing import pack
from pagesheaf.llm.quality import fit, quality_score
from pagesheaf.llm.similar import keep_one_similar
from pagesheaf.llm.token_counts import token_counts

# Quality below this goes. A stated language that is contradicted with at least this score goes.
MIN_QUALITY, CONTRADICTED = 0.3, 0.1
MAX_PASSES = 2.0
# Near copies share this part of their five-word shingles, as Jaccard index.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is at least ``MIN_QUALITY``, learned from the labelled rows among them."""
    small_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(spark, model, F.col("text")) >= MIN_QUALITY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language: not those without a letter, nor those whose stated language the text clearly contradicts."""
    small_batches(spark)
    found = language_of(reference_texts(docs), F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), found.alias("found"))
    stated = F.col("row.lang")
    wrong = stated.isNotNull() & (stated != F.col("found.lang_pred")) & (F.col("found.score") >= CONTRADICTED)
    return rows.where((F.col("found.lang_pred") != "und") & ~wrong).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: sets of five-word shingles with a similarity of ``SIMILARITY`` or more.

    Fingerprints of such pairs differ in up to 13 bits and more, which no covering finds in a small number of anchors,
    so the pairs are found by prefix filtering and decided on the whole sets.
    """
    small_batches(spark)
    return keep_one_similar(docs, shingle=5, similarity=SIMILARITY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row once, those of small sources up to ``MAX_PASSES`` times. A repeated row is a row of the result again."""
    return mixed_documents(docs, max_passes=MAX_PASSES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in training sequences, by their numbers of tokens."""
    small_batches(spark)
    return pack(token_counts(docs))


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("mixing sources", mixture),
    ("best-fit packing", packing),
]

# Classifiers, hashes and the packing can't be written in SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
