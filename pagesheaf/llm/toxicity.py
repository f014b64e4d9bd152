"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import fold_of
from pagesheaf.llm.quality import labelled_sample

# Bound of the labelled sample, rows of each label.
SAMPLE = 3000
# Slots of the hashed features, passes over the sample, and the learner's rates and penalties.
SLOTS_LOG2, PASSES = 20, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.5
# A feature is learned if at least so many rows of the sample have it.
MIN_ROWS = 8
# Words of a text that are hashed at a time.
CHUNK = 1 << 18

# ASCII letters in lower case, digits and all bytes of other characters stay; everything else parts words.
_WORD = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in bytes(range(256)).lower())


def _mixed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(kind)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def _slots(text: str | None) -> Iterator[np.ndarray]:
    """Slots of all words, pairs of neighbours and pairs with one word between them, a chunk at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()
    for i in range(0, len(words), CHUNK):
        h = np.fromiter(map(crc32, words[i:i + CHUNK + 2]), np.uint64)
        own = h[:CHUNK]
        yield _mixed(own, np.zeros_like(own), 1)
        pairs, skips = min(len(own), len(h) - 1), min(len(own), len(h) - 2)
        if pairs > 0:
            yield _mixed(h[:pairs], h[1:pairs + 1], 2)
        if skips > 0:
            yield _mixed(h[:skips], h[2:skips + 2], 3)


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0)


def train(rows: list[tuple[np.ndarray, int]], passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) of the non-zero weights. Each row is the distinct slots of a text and its label.

    Every coordinate has its own rate, from the squares of its gradients so far, and stays at zero until their sum
    passes L1. The bias, in the last place, has no penalty. Both labels weigh the same in all.
    """
    size = (1 << SLOTS_LOG2) + 1
    seen = np.bincount(np.concatenate([s for s, _ in rows]), minlength=size)
    rows = [(np.append(s[seen[s] >= MIN_ROWS], size - 1), y) for s, y in rows]
    toxic = sum(y for _, y in rows)
    share = {1: len(rows) / 2 / toxic, 0: len(rows) / 2 / (len(rows) - toxic)}
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            za, na = z[at], n[at]
            w = _weights(za, na)
            w[-1] = -za[-1] / ((BETA + np.sqrt(na[-1])) / ALPHA + L2)
            g = (_sigmoid(w.sum()) - y) * share[y]
            z[at] = za + g - (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA * w
            n[at] = na + g * g
    w = _weights(z[:-1], n[:-1])
    kept = np.nonzero(w)[0]
    return kept, w[kept].astype(np.float32), float(-z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE):
    """Weights learned from a bounded labelled sample, or None if one of the two labels does not occur in it."""
    rows = labelled_sample(docs, labels, "toxic", fold_of("doc_id", folds) != held, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, label in zip(b.column(0), b.column(1)):
                slots = list(_slots(x.as_py()))
                data = np.unique(np.concatenate(slots)).astype("<u4").tobytes() if slots else b""
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([label], pa.int32())], ["slots", "label"])

    # Copies of a text count once.
    got = sorted({(bytes(r.slots), r.label) for r in rows.mapInArrow(run, "slots binary, label int").collect()})
    if len({label for _, label in got}) < 2:
        return None
    return train([(np.frombuffer(s, "<u4").astype(np.int64), label) for s, label in got])


def score_toxicity(docs: DataFrame, model) -> DataFrame:
    """Rows (doc_id, score), one per row of ``docs``. Without a model every score is 0."""
    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model:
            dense = np.zeros(1 << SLOTS_LOG2, np.float32)
            dense[model[0]] = model[1]
        for b in batches:
            scores = np.zeros(b.num_rows)
            for i, x in enumerate(b.column(1) if model else ()):
                hit = [s[dense[s] != 0] for s in _slots(x.as_py())]
                slots = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
                scores[i] = _sigmoid(model[2] + dense[slots].sum(dtype=np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``.

    A feature counts once per text, however often it occurs. Learns from labelled rows outside the held-out fold only;
    label, language, source and id are no inputs of a score. Null texts count as empty and have the score of the bias
    alone; repeated rows stay repeated; a null id is kept (fold 0). Empty tables give no rows, a table without both
    labels the score 0 throughout. Other columns are not read.
    """
    scored = score_toxicity(docs, fit(docs, labels, folds, held))
    held_out = (fold_of("doc_id", folds) == held).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
