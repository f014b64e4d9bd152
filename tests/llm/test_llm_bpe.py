"""BPE encoding and decoding against the library, pre-tokens and whole queries."""

import hashlib
import random
import sys

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])

from fixtures import documents, empty  # noqa: E402

from pagesheaf.llm import bpe, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def library(request):
    import public_tokenizers
    from tokenizers import Tokenizer

    return request.param, Tokenizer.from_file(public_tokenizers.path(request.param))


@pytest.fixture(scope="module")
def words():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(texts, name):
    ids, counts = bpe._encode(texts, name)
    ends = counts.cumsum().tolist()
    return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


def test_ids_of_odd_texts(words):
    random.seed(7)
    characters = [chr(c) for lo, hi in ((0, 0x80), (0x80, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x20000))
                  for c in random.sample(range(lo, hi), min(400, hi - lo))]
    texts = ["".join(random.choice(characters) for _ in range(50)) for _ in range(800)]
    texts += ["".join(chr(random.randrange(0x80)) for _ in range(40)) for _ in range(400)]
    texts += ["", " \n\t", "aaaaaaaaaaaaa", "ab" * 3000, "ΣΑΣ ΟΔΟΣ", "İ ß ŉ ǅ", "é ẛ̣"]
    texts += ["<|endoftext|>", "a<|startoftext|><|endoftext|>b", "<|endoftext|", "a\x00b\x1cc\x7fd\xa0e f", "don't WE'LL 'S"]
    assert encoded(texts, "word_bpe_49k.json") == [words.encode(t, add_special_tokens=False).ids for t in texts]


def test_rounds_and_forgetting(words, monkeypatch):
    """A lexicon that is emptied again and again gives the same ids, special strings included."""
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    bpe._lexicon.cache_clear()
    texts = [f"word{i} {i} <|endoftext|> again {'z' * (i % 9)}" for i in range(200)]
    for i in range(0, 200, 20):
        assert encoded(texts[i:i + 20], "word_bpe_49k.json") == [words.encode(t, add_special_tokens=False).ids for t in texts[i:i + 20]]
    bpe._lexicon.cache_clear()


def test_pair_index_is_merging_word_by_word():
    """A tiny vocabulary, all words up to six letters: lowest rank first, the leftmost of equal ones."""
    from itertools import product

    vocab = {c: i for i, c in enumerate(["a", "b", "aa", "ab", "aab", "aaab", "ba"])}
    merges = [("a", "a"), ("aa", "b"), ("a", "b"), ("b", "a"), ("a", "aab")]
    ranks = {vocab[a] * 7 + vocab[b]: r for r, (a, b) in enumerate(merges)}
    parts = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
    letters = {"a": 0, "b": 1}
    model = bpe.Model(letters, letters, ranks, parts, 7, list(vocab), {}, str.split)
    every = ["".join(w) for n in range(7) for w in product("ab", repeat=n)]

    def alone(word):
        found = list(word)
        while True:
            best = min(((merges.index(p), i) for i, p in enumerate(zip(found, found[1:])) if p in merges), default=None)
            if best is None:
                return [vocab[s] for s in found]
            i = best[1]
            found[i:i + 2] = [found[i] + found[i + 1]]

    ids, sizes = bpe.merged(every, model)
    ends = sizes.cumsum().tolist()
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [alone(w) for w in every]


def test_other_vocabularies_are_cut_by_the_library(library):
    """Files without a decoder are taken whatever their normaliser; one with a decoder is refused."""
    name, tokenizer = library
    if name == "byte_bpe_50k.json":
        with pytest.raises(ValueError):
            bpe._model(name)
    else:
        assert bpe._model(name).strings[:10] == [tokenizer.id_to_token(i) for i in range(10)]


def test_fixture_round_trip(spark, words):
    docs = documents(spark)
    rows = bpe.decode(bpe.encode(docs)).collect()
    want = sorted(((r.doc_id, words.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == want
    assert all(r.decoded == words.decode(r.ids, skip_special_tokens=False) for r in rows)
    assert bpe.encode(empty(spark)).count() == 0 and bpe.decode(bpe.encode(empty(spark))).count() == 0
    some = spark.createDataFrame([(1, None, "old"), (2, [], "old")], "doc_id int, ids array<int>, decoded string")
    assert [r.decoded for r in bpe.decode(some).orderBy("doc_id").collect()] == [None, ""]


def test_query(spark, words):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = words.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(words.decode(ids, skip_special_tokens=False).encode()).hexdigest()
