"""Queries and stages do their whole job: cases that a cheaper stand-in gets wrong."""

import math
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])

from fixtures import documents, empty  # noqa: E402
from test_llm_models import bm25  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from pagesheaf.llm import queries, search, similar  # noqa: E402
from pagesheaf.llm.common import stored  # noqa: E402


def test_packing_query_packs_tokens(spark, tmp_path):
    """8,191 words are more tokens than a sequence of 8,192 holds, a text without blanks is more than one."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "untokenisable " * 8191, 2: "x1y2" * 5000, 3: "\u4e2d\u6587" * 300, 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_packing(spark, str(tmp_path)).collect()
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert sum(r.doc_id == 1 for r in rows) > 1
    assert sum(r.piece_tokens for r in rows) == sum(want.values()) + len(want)


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def kept_by_force(rows):
    """Smallest ids of the components of all pairs of a five-word Jaccard index of 0.8 or more."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            s, t = sets[i], sets[j]
            if s == t or (min(len(s), len(t)) >= 0.8 * max(len(s), len(t)) and len(s & t) >= 0.8 * len(s | t)):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted(least.values())


@pytest.mark.parametrize("star, late, cell", [(16, 8, 4096), (3, 2, 4096), (3, 2, 5), (16, 2, 3)])
def test_near_copy_stage_reaches_five_word_similarity(spark, monkeypatch, star, late, cell):
    """Near copies with edited words, also around one text, beside a passage that many texts share."""
    monkeypatch.setattr(similar, "STAR", star)
    monkeypatch.setattr(similar, "LATE", late)
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "HUB", 4)
    rng, rows = np.random.default_rng(11), []
    passage = [f"common{i}" for i in range(20)]
    for c in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 40 + 15 * c)]
        for _ in range(10):
            words = list(base)
            for at in rng.choice(len(words), rng.integers(0, 5), replace=False):
                words[at] = f"e{rng.integers(0, 9999)}"
            rows.append((len(rows), " ".join(words + passage * int(c % 2))))
    rows += [(500, ""), (501, None), (502, "two words"), (503, "Two  words"), (504, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = kept_by_force(rows)
    assert sorted(r.doc_id for r in pipeline.near_copies(spark, docs, "").collect()) == want and len(want) < 100


def test_near_copy_stage_keeps_different_texts_of_one_id(spark):
    """Rows of one id are told apart, repeated rows are one, rows without an id stay."""
    rows = [(1, "a b c d e f g"), (2, "one two three four five six"), (2, "six other words are of this text"), (2, "six other words are of this text"), (3, "a b c d e f g"), (None, "q"), (None, "q")]
    kept = pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(map(tuple, kept), key=repr) == sorted([rows[0], rows[1], rows[2], rows[5], rows[6]], key=repr)
    assert pipeline.near_copies(spark, empty(spark), "").count() == 0 and pipeline.near_copies(spark, documents(spark), "").columns == documents(spark).columns


def test_sketches_drop_no_similar_sets():
    rng = np.random.default_rng(5)
    dropped = 0
    for n in (0, 1, 2, 63, 64, 65, 130, 400, 3000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        for keep in (1.0, 0.95, 0.89, 0.8, 0.5, 0.0):
            other = np.unique(np.concatenate((base[: int(n * keep)], rng.integers(0, 2**64, n - int(n * keep), dtype=np.uint64))))
            mine = np.unique(base[: max(n - n // 9, min(n, 1))] if keep == 1 else base)
            a, b = (len(x).to_bytes(8, "little") + similar.parity_sketch(x) for x in (mine, other))
            shared = len(np.intersect1d(mine, other))
            assert similar._least_apart(a[8:], b[8:]) <= len(mine) + len(other) - 2 * shared
            alike = shared >= 0.8 * (len(mine) + len(other) - shared) - 1e-9
            may = similar.may_be_similar(a, b, 0.8)
            assert may == similar.may_be_similar(b, a, 0.8) and (may or not alike)
            dropped += not may
    assert dropped >= 15


def test_texts_move_only_for_pairs_that_sketches_allow(spark, monkeypatch):
    texts = [" ".join(f"w{(7 * i) ** 2 + j}" for j in range(60)) for i in range(40)]
    texts.append(texts[0].replace("w59", "x"))
    nodes = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "node bigint, text string").repartition(3)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 41)], "u bigint, v bigint")
    moved, compared = [], similar._compared
    monkeypatch.setattr(similar, "_compared", lambda pairs, *a: moved.append(pairs.count()) or compared(pairs, *a))
    got = similar._verified(pairs, nodes, similar.sketches(nodes, 5), 5, 0.8, "test-links").collect()
    assert [tuple(r) for r in got] == [(40, 0)] and moved == [40, 1]


def test_pipeline_sends_small_batches(spark):
    from pagesheaf.llm.common import BATCH_ROWS, small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("500", 500)):
            spark.conf.set(key, given)
            small_batches(spark)
            assert int(spark.conf.get(key)) == want
    finally:
        spark.conf.set(key, before)


def test_search_query_is_the_whole_text(spark, monkeypatch, tmp_path):
    """Query 20 has 60 rare words and a long passage of middling ones; documents with its passage beat one rare word."""
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {i: " ".join(f"m{x}" for x in rng.integers(0, 80, 60)) for i in range(1, 90) if i != 20}
    for i in range(41, 56):
        texts[i] += " " + passage
    for i in range(60):
        texts[1 + i % 19] += f" rare{i}"
    texts[20] = passage + " p1 p1 p1 " + " ".join(f"rare{i}" for i in range(60))
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in queries.op5_search(spark, str(tmp_path)).collect())
    tf = {i: Counter(t.split()) for i, t in texts.items()}
    df = Counter(t for c in tf.values() for t in c)
    n, mean, want = len(tf), sum(c.total() for c in tf.values()) / len(tf), []
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    for q in (i for i in tf if i % 20 == 0):
        scores = {}
        for d in tf:
            norm = search.K1 * (1 - search.B + search.B * tf[d].total() / mean)
            hit = [t for t in tf[q] if tf[d][t]]
            if hit and d != q:
                scores[d] = sum(tf[q][t] * idf[t] * tf[d][t] * (search.K1 + 1) / (tf[d][t] + norm) for t in hit)
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        want += [(q, r, d, round(s, 7)) for r, (d, s) in enumerate(ranked, 1)]
    assert got == sorted(want) and {d for q, _, d, _ in got if q == 20} <= set(range(41, 56))


@pytest.mark.parametrize("docs_, postings, entries", [(7, 1 << 20, 1 << 20), (12_000, 90, 1 << 20), (12_000, 1 << 20, 300), (1, 1, 1)])
def test_search_in_shards_and_chunks(spark, monkeypatch, docs_, postings, entries):
    """Equal documents in different shards, and a query whose own document is in one of them: ties go to the smaller id."""
    for name, value in (("SHARD_DOCS", docs_), ("SHARD_POSTINGS", postings), ("CHUNK_ENTRIES", entries), ("BLOCK_DOCS", 2)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"m{x}" for x in rng.integers(0, 30, 1 + i % 25))) for i in range(1, 61)]
    rows += [(i + 100, t) for i, t in rows] + [(300, "only"), (320, ""), (340, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in search.top_documents(docs, k=4).collect())
    assert got == bm25(rows, 4, None) and {q for q, *_ in got} == {20, 40, 60, 120, 140, 160}


def test_search_moves_no_postings(spark):
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(50)], "doc_id bigint, text string").repartition(2)
    index = search._index(stored(docs, "test-docs"), "")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    assert sum(len(r.doc_ids) // 8 for r in index.collect()) == 50


def test_search_hashes_tell_terms_apart(spark, monkeypatch):
    stats = spark.createDataFrame([("a", 1), ("b", 1), (None, 2)], "term string, df bigint")
    assert search._unlike(stats) == ""
    told = search._hash
    monkeypatch.setattr(search, "_hash", lambda salt: told(salt) if salt else F.xxhash64(F.lit(1)))
    assert search._unlike(stats) == "\x00"


def test_sketches_are_compared_in_arrays():
    """In arrays as one by one; texts of 8 to 2,100 shingles, so that sketches have several lengths."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 8, 60, 64, 65, 120, 129, 300, 520, 1500, 2100):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[: int(n * k)], rng.integers(0, 2**64, m, dtype=np.uint64)))) for k in (1, 0.95, 0.9, 0.5) for m in (0, n // 9)]
    values = [len(x).to_bytes(8, "little") + similar.parity_sketch(x) for x in sets]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    near = similar._Sketches(pa.array([b"", *values], pa.binary())[1:]).may_be_similar(i, j, 0.8)
    for a, b, got in zip(i, j, near):
        longer, shorter = sorted((len(values[a]), len(values[b])), reverse=True)
        assert got == (longer - 8 > 2 * (shorter - 8) or similar.may_be_similar(values[a], values[b], 0.8))


def test_pairs_of_large_keys_leave_their_task_only_if_sketches_allow(spark, monkeypatch):
    """Sixty texts that share a passage of frequent shingles, two of which are near copies."""
    monkeypatch.setattr(similar, "LATE", 99)
    passage = " ".join(f"common{i}" for i in range(30))
    texts = [f"{passage} " + " ".join(f"t{i}w{j}" for j in range(25)) for i in range(60)]
    texts.append(texts[59].replace("w24", "x"))
    nodes = [(int(similar._node(similar.shingle_set(x, 5))), x) for x in texts]
    moved, verified = [], similar._verified
    monkeypatch.setattr(similar, "_verified", lambda pairs, *a: moved.append(sorted(map(tuple, pairs.distinct().collect()))) or verified(pairs, *a))
    similar.similar_links(spark.createDataFrame(nodes, "node bigint, text string"), 5, 0.8).count()
    near = {nodes[59][0], nodes[60][0]}
    assert all(set(p) == near for p in moved[1])


def test_only_texts_of_pairs_are_exchanged(spark):
    values = spark.range(20_000).select(F.col("id").alias("node"), F.col("id").cast("string").alias("value"))
    pairs = spark.createDataFrame([(5, 7), (7, 19_999)], "u bigint, v bigint")
    got = {r.node for r in similar._of_pairs(values, pairs).collect()}
    assert {5, 7, 19_999} <= got and len(got) < 10
