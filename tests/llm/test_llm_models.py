"""Language, quality, toxicity, search, nearest neighbours, mixing and packing against plain versions."""

import math
import sys
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rpartition("/")[0])
from fixtures import documents, empty, pairs, prose  # noqa: E402

from pagesheaf.llm import forest, language, mixing, packing, quality, search, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def fold(i, m):
    return crc32(("" if i is None else str(i)).encode()) % m


def phrases(text, reference):
    """Greedy longest matches by substring search."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i:j + 1] in reference:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("block", [50, 1024])
def test_cross_parsing_takes_longest_matches(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    references = (("a", prose(1, 60)), ("b", prose(2, 80)[::-1]))
    code_of, parsers, _ = language._model(references)
    texts = [prose(7, 40), "xyz the of Ω Ω the", prose(2, 5)[::-1], "q"]
    for text in texts:
        codes = language._codes(text, code_of)
        blocks = [codes[i:i + block] for i in range(0, len(codes), block)]
        for (_, reference), parser in zip(references, parsers):
            known = "".join(chr(256 + int(c)) for c in language._codes(reference, code_of))
            want = [phrases("".join(chr(256 + int(c)) for c in b), known) for b in blocks]
            order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
            got = language._phrases([blocks[i] for i in order], parser)
            assert [want[i] for i in order] == got.tolist()


def test_language(spark):
    docs = documents(spark)
    got = pairs(language.identify_language(docs), "doc_id", "held_out", "lang_pred")
    assert len(got) == docs.count()
    assert {(i, h) for i, h, _ in got} == {(r.doc_id, fold(r.doc_id, 5) == 0) for r in docs.collect()}
    assert {p for i, _, p in got if i in (100, 101, 102, 140)} == {"und"}
    assert language.identify_language(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify_language(docs.where("lang is null")).collect()} == {"und"}


def test_numerals_are_no_letters(spark):
    rows = [(0, "² ½", None), (5, "Ⅷ ①", None), (6, "12 %", None), (7, "ª", None), (8, "Ⅷ a", None)]
    learned = [(i, "plain words of one language stand here", "en") for i in range(20, 40)]
    docs = spark.createDataFrame(rows + learned, "doc_id bigint, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_language(docs).collect()}
    assert [found[i] for i in (0, 5, 6)] == [("und", 0.0)] * 3 and found[7][0] == found[8][0] == "en"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify_language(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify_quality(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    mixed = quality.classify_quality(documents(spark), labels)
    assert mixed.count() == documents(spark).count() and mixed.where("score < 0 or score > 1 or score is null").count() == 0
    assert quality.classify_quality(empty(spark), labels).count() == 0
    assert {r.score for r in quality.classify_quality(documents(spark), labels.limit(0)).collect()} == {0.5}


def test_votes_are_those_of_all_labelled_vectors():
    rng = np.random.default_rng(1)
    z = quality._project(rng.standard_normal((40, 8)), np.eye(8)).astype(np.float32)
    model = quality.Neighbours(np.ones(8), np.eye(8), z, (np.arange(40) % 2).astype(np.float32), np.ones(40, np.float32))
    for q, got in zip(z[:5], quality._vote(z[:5], model)):
        near = np.argsort(-(z @ q))[: quality.NEIGHBOURS]
        w = np.maximum(z[near] @ q, 0).astype(float) ** 4 + 1e-9
        assert got == pytest.approx((w * model.labels[near]).sum() / w.sum(), rel=1e-5)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify_toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.03 * len(rows)
    mixed = toxicity.classify_toxicity(documents(spark), labels)
    assert mixed.count() == documents(spark).count() and mixed.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.classify_toxicity(empty(spark), labels).count() == 0
    assert {r.score for r in toxicity.classify_toxicity(documents(spark), labels.limit(0)).collect()} == {0.0}


def test_toxic_words_are_learned_and_counted_once(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [(" ".join(rng.choice(["a", "b", "c", "d"], 30)) + (" foul" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    rows = [(np.unique(np.concatenate(list(toxicity._slots(t)))), y) for t, y in texts]
    slots, weights, bias = toxicity.train(rows)
    table = dict(zip(slots.tolist(), weights.tolist()))
    foul = int(next(toxicity._slots("foul"))[0])
    assert table[foul] + bias > 1 and len(table) < 60
    whole = np.concatenate(list(toxicity._slots(prose(1, 700))))
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert Counter(whole.tolist()) == Counter(np.concatenate(list(toxicity._slots(prose(1, 700)))).tolist())


def bm25(rows, k, n_terms):
    words, df, n, total = defaultdict(list), Counter(), 0, 0
    one = {}
    for i, t in rows:
        one[i] = min(t or "", one.get(i, t or ""))
    for i, t in one.items():
        if i is not None:
            terms = [x.decode() for x in search._terms(t)]
            words[i] += terms
            df.update(set(terms))
            n, total = n + 1, total + len(terms)
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    tf = {i: Counter(w) for i, w in words.items()}
    out = []
    for i in (i for i in words if i % 20 == 0):
        weigh = lambda t: idf[t] * tf[i][t] / (tf[i][t] + search.K1)  # noqa: B023, E731
        query = sorted((t for t in tf[i] if df[t] > 1), key=lambda t: (-weigh(t), t))[:n_terms]
        scores = {}
        for d, w in words.items():
            norm = search.K1 * (1 - search.B + search.B * len(w) / (total / n))
            hit = [t for t in query if tf[d][t]]
            if hit and d != i:
                scores[d] = sum(idf[t] * tf[d][t] * (search.K1 + 1) / (tf[d][t] + norm) for t in sorted(hit))
        ranked = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(i, r, d, round(s, 7)) for r, (d, s) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(20_000, 64), (15, 2)])
def test_search(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    docs = documents(spark).union(documents(spark).where("doc_id < 40").selectExpr(
        "doc_id + 200", "concat(text, ' ', text)", "lang", "source", "score", "n_chars", "copies", "_h", "full", "row"))
    got = sorted((r.query_id, r.rank, r.doc_id, round(r.score, 7)) for r in search.top_documents(docs, k=5).collect())
    assert got == bm25([(r.doc_id, r.text) for r in docs.collect()], 5, search.QUERY_TERMS)
    assert search.top_documents(empty(spark)).count() == 0


def test_nearest_finds_all_in_small_tables(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 6)) * rng.uniform(0.2, 3, (150, 1))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    bad = [(200, [0.0] * 6, ""), (220, None, ""), (240, [float("nan")] * 6, ""), (260, [None] * 6, ""), (None, [1.0] * 6, ""), (280, [1.0], "")]
    table = spark.createDataFrame(rows + bad + rows[:3], "vec_id bigint, embedding array<double>, score string")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in forest.nearest(table, k=20, recall=1.0).collect()]
    products = x @ x.T
    want = []
    for i in range(0, 150, 20):
        order = sorted((j for j in range(150) if j != i), key=lambda j: (-round(products[i, j], 12), j))[:20]
        want += [(i, r, j, round(products[i, j], 9)) for r, j in enumerate(order, 1)]
    assert sorted(got) == sorted(want)
    assert forest.nearest(table.limit(0)).count() == 0
    few = forest.nearest(table.where("vec_id < 5"), k=20)
    assert few.count() == 4


def test_nearest_recall_with_split_leaves_and_slices(spark, monkeypatch):
    monkeypatch.setattr(forest, "SLICE", 100)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((600, 16)) + 4 * rng.standard_normal((1, 16)) for _ in range(4)])
    x[:700] = x[0]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = forest.nearest(table, k=20).collect()
    y = x.astype(np.float32).astype(float)
    products, per = y @ y.T, defaultdict(list)
    for r in got:
        per[r.query_id].append(r.score)
    hits = 0
    for i in range(0, len(x), 20):
        others = np.sort(np.delete(products[i], i))[::-1]
        hits += sum(s >= others[19] - 1e-6 for s in per[i])
    assert hits >= 0.9 * 20 * len(range(0, len(x), 20))


def recall_of(spark, x, monkeypatch, queries):
    """Recall of the first 20 for some queries, and the strings that were held to be enough, by the rule of production."""
    seen = []
    measure = forest._enough
    monkeypatch.setattr(forest, "_enough", lambda *a: seen.append(measure(*a)) or seen[-1])
    names = "vec_id bigint, embedding array<float>, vec string, query string, leaf string, slice int, tree int, code int"
    table = spark.createDataFrame([(i, r, "v", "q", "l", 1, 2, 3) for i, r in enumerate(x.tolist())], names)
    got = forest.nearest(table, F.col("vec_id") % queries == 0).collect()
    monkeypatch.undo()
    asked = np.arange(0, len(x), queries)
    products = x[asked].astype(float) @ x.T.astype(float)
    products[np.arange(len(asked)), asked] = -np.inf
    best = {(int(q), int(v)) for q, row in zip(asked, np.argsort(-products, axis=1)[:, :20]) for v in row}
    return len(best & {(r.query_id, r.vec_id) for r in got}) / len(best), seen[-1]


def test_nearest_recall_at_three_sizes_by_one_rule(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for n, queries in ((2_000, 5), (20_000, 50), (60_000, 150)):
        found, _ = recall_of(spark, rng.standard_normal((n, 32)).astype(np.float32), monkeypatch, queries)
        assert found >= 0.92, (n, found)


def test_nearest_visits_few_strings_where_vectors_have_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((200, 32)), 60, axis=0) + 0.1 * rng.standard_normal((12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found, enough = recall_of(spark, x.astype(np.float32), monkeypatch, 20)
    assert found >= 0.92 and enough < 0.15 * len(x), (found, enough)


def test_nearest_ascends_by_the_length_of_the_shared_prefix(spark):
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << forest.BITS, (500, forest.TREES))
    rows = [(t, int(c), 1) for t in range(forest.TREES) for c in codes[:, t]]
    leaves = forest._leaves(spark.createDataFrame(rows, "tree int, code bigint, n bigint"), 500, 1 / 64)
    assert leaves[:, 3].sum() == 500 * forest.TREES and leaves[:, 3].max() <= 500 / 64
    order, before = forest._ascent(codes[:3], leaves)
    for q in range(3):
        shared = []
        for tree, first, depth, _ in leaves[order[q]].tolist():
            a, b = (f"{c:0{forest.BITS}b}"[:depth] for c in (int(codes[q, tree]), first))
            shared.append(next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), depth))
        assert shared == sorted(shared, reverse=True)
        assert before[q].tolist() == [0, *np.cumsum(leaves[order[q], 3]).tolist()][:-1]
        held = forest._leaf_of(codes, leaves, 0)
        assert all(leaves[at, 1] <= codes[i, 0] for i, at in enumerate(held)) and set(held) <= set(np.nonzero(leaves[:, 0] == 0)[0])


def test_mixing_meets_the_limit_and_keeps_every_row(spark):
    docs = documents(spark)
    order = mixing.mixed_order(docs, max_passes=2.0, block_tokens=500)
    rows = order.collect()
    passes = Counter((r.doc_id, r.source, r["pass"]) for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert max(passes.values()) <= 2 and max(r["pass"] for r in rows) <= 1
    tokens = {r.source: r.t for r in docs.groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "t").collect()}
    assert set(tokens) == {r.source for r in rows}
    places = Counter((r.block, r.place) for r in rows)
    assert max(places.values()) == 1
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs, max_passes=2.0).count() == len(rows)
    assert mixing.mixed_order(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mixing_exponent_and_passes(spark):
    size = {"big": 900, "mid": 60, "small": 40}
    rows = [(hash((s, i)) % 10**9, "w " * 10, s) for s, n in size.items() for i in range(n // 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    _, sources = mixing.mixing_plan(docs, max_passes=3.0)
    got = {r.source: r.passes for r in sources.collect()}
    share = {s: n / 1000 for s, n in size.items()}
    exponent = 1 - math.log(3) / math.log(900 / 40)
    for s in size:
        assert got[s] == pytest.approx((share[s] / 0.9) ** (exponent - 1), rel=1e-5)
    _, sources = mixing.mixing_plan(docs, max_passes=None, entropy=0.9, budget=1000)
    w = [r.weight for r in sources.collect()]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.9, abs=1e-6)
    order = mixing.mixed_order(docs, max_passes=None, entropy=0.9, budget=1000).toPandas()
    by = order.groupby("source").n_tokens.sum()
    for r in sources.collect():
        assert abs(by[r.source] - 1000 * r.weight) <= 10
    blocks = mixing.mixed_order(docs, max_passes=3.0, block_tokens=400).toPandas().groupby("block").n_tokens.sum()
    assert blocks.max() - blocks.min() <= 60


def test_packing(spark):
    sizes = [(i, int(x)) for i, x in enumerate(np.random.default_rng(6).integers(0, 9000, 400))]
    sizes += [(500, None), (501, 0), (501, 0), (None, 30_000), (502, 8191), (503, 8192)]
    units = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    p = packing.pack(units).toPandas()
    assert sorted(p.groupby("doc_id", dropna=False).size().index.fillna(-1)) == sorted({-1 if i is None else i for i, _ in sizes})
    assert p.piece_tokens.sum() == sum((n or 0) + 1 for _, n in sizes)
    used = p.groupby("bin_id").agg(used=("piece_tokens", "sum"), length=("bin_length", "first"))
    lengths = np.array(packing.LENGTHS)
    assert (used.length == lengths[np.searchsorted(lengths, used.used)]).all()
    for _, b in p.sort_values("bin_start").groupby("bin_id"):
        ends = (b.bin_start + b.piece_tokens).tolist()
        assert b.bin_start.tolist() == [0, *ends[:-1]]
    assert used.used.sum() / used.length.sum() > 0.97
    assert packing.pack(units.limit(0)).count() == 0


def test_packing_is_no_dearer_than_any_single_length():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 2000, 500)
    bins, starts, lengths = packing.pack_sizes(sizes)
    total = sum(packing.cost(int(c)) for c in {b: c for b, c in zip(bins, lengths)}.values())
    for one in packing.LENGTHS[2:]:
        b, _, _ = packing.pack_sizes(sizes, (one,))
        assert total <= len(set(b.tolist())) * packing.cost(one)


def test_packing_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 20)
    p = packing.pack(spark.range(200).selectExpr("id as doc_id", "id * 7 as n_tokens")).toPandas()
    assert len(p) == 200 and (p.groupby("bin_id").piece_tokens.sum() <= p.groupby("bin_id").bin_length.first()).all()
    assert p.bin_id.map(lambda b: b >> 32).nunique() > 3
