"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesheaf.llm.common import drawn_rows, fold_of

# Bound of the labelled sample, rows of each label.
SAMPLE = 1500
# Hashed terms, latent dimensions, neighbours that vote.
TERMS_LOG2, DIMENSIONS, NEIGHBOURS = 11, 64, 15
# Documents whose cosines are computed at a time, and bytes of a text that are counted at a time.
BLOCK, CHUNK = 1024, 1 << 20
_GRAMS = 1 << TERMS_LOG2
# One more term: a word equal to the one before it. It stands for a whole class of texts, so it weighs as much as many.
REPEAT_WEIGHT = 8.0
TERMS = _GRAMS + 1


def _counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams and of repeated words of a whole text."""
    out = np.zeros(TERMS, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    for i in range(0, max(len(data) - 2, 0), CHUNK):
        b = np.frombuffer(data[i:i + CHUNK + 2], np.uint8).astype(np.uint32)
        grams = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        grams *= np.uint32(2_654_435_761)
        grams >>= np.uint32(32 - TERMS_LOG2)
        out[:_GRAMS] += np.bincount(grams, minlength=_GRAMS)
    words = data.split()
    out[_GRAMS] = sum(map(bytes.__eq__, words, words[1:]))
    return out


@dataclass(frozen=True)
class Neighbours:
    """A bounded model: term weights, the projection, and the labelled vectors with their votes."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    x[:, _GRAMS] *= REPEAT_WEIGHT
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _project(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    z = x @ projection
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold, sample: int) -> DataFrame:
    """Rows (text, label), at most ``sample`` of each of the labels 0 and 1, from rows that ``fold`` allows.

    The ids are drawn first, by a hash, and are few enough to be broadcast; the texts then need no exchange. A document
    labelled more than once has its largest label. Rows of repeated ids count towards the bound.
    """
    marks = labels.where(fold & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("_h", F.xxhash64("doc_id"))
    drawn = drawn_rows(marks, "label", "_h", sample).select("doc_id", "label", "_h")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = texts.withColumn("_t", F.xxhash64("_h", "text"))
    first = F.row_number().over(Window.partitionBy("label").orderBy("_t")) <= sample
    return texts.withColumn("_first", first).where("_first").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Neighbours | None:
    """The model of a bounded labelled sample, or None if there are no labelled rows outside the held-out fold."""
    rows = labelled_sample(docs, labels, "quality", fold_of("doc_id", folds) != held, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_counts(x.as_py()).tobytes() for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), b.column(1)], ["counts", "label"])

    got = sorted((bytes(r.counts), r.label) for r in rows.mapInArrow(run, "counts binary, label int").collect())
    if not got:
        return None
    counts = np.stack([np.frombuffer(c, np.float32) for c, _ in got]).astype(np.float64)
    y = np.array([label for _, label in got], np.float32)
    idf = np.log((1 + len(y)) / (1 + (counts > 0).sum(0))) + 1
    x = _weighted(counts, idf)
    _, vectors = np.linalg.eigh(x.T @ x)
    projection = vectors[:, ::-1][:, :DIMENSIONS]
    # Both labels have the same weight in all, however many rows each has.
    share = np.where(y == 1, 1 / max(y.sum(), 1), 1 / max((1 - y).sum(), 1))
    z = _project(x, projection)
    return Neighbours(*(a.astype(np.float32) for a in (idf, projection, z, y, share / share.max())))


def _vote(z: np.ndarray, model: Neighbours) -> np.ndarray:
    cosines = z @ model.vectors.T
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 4 * model.votes[near] + 1e-9
    return (weight * model.labels[near]).sum(1) / weight.sum(1)


def quality_score(spark: SparkSession, model: Neighbours | None, text: Column) -> Column:
    """The score of a text as a column; 0.5 throughout without a model."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in parts:
            scores = np.full(len(texts), 0.5)
            for i in range(0, len(texts) if m else 0, BLOCK):
                counts = np.stack([_counts(x) for x in texts[i:i + BLOCK]])
                scores[i:i + BLOCK] = _vote(_project(_weighted(counts, m.idf), m.projection), m)
            yield pd.Series(np.clip(scores, 0, 1))

    return score(text)


def classify_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``.

    Every document is compared with every labelled vector, and the nearest vote with the fourth power of their cosine.
    Learns from labelled rows outside the held-out fold only; label, language, source and id are no inputs of a score.
    Null texts count as empty and get the score of a text without terms; repeated rows stay repeated; a null id is kept
    (fold 0). Empty tables give no rows, a table without labels the score 0.5 throughout. Other columns are not read.
    """
    score = quality_score(docs.sparkSession, fit(docs, labels, folds, held), F.col("text"))
    scored = docs.select("doc_id", score.alias("score"))
    held_out = (fold_of("doc_id", folds) == held).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
