"""Token counts, fingerprints and near copies, licences against plain versions."""

import math
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from fixtures import documents, empty, pairs, prose  # noqa: E402

from pagesheaf.llm import licenses, simhash, token_counts  # noqa: E402


def test_token_counts_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = documents(spark)
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False))) for i, t in texts]
    want = sorted(((*w, w[2] > 512) for w in want), key=repr)
    assert pairs(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_lexicon_may_be_forgotten(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    monkeypatch.setattr(token_counts, "ROUND_CHARS", 100)
    lexicon = token_counts._lexicon("byte_bpe_50k.json")
    lexicon.clear()
    cut = token_counts._pretokens("byte_bpe_50k.json")
    pretokens, special = cut("a bb ccc <|endoftext|> dddd")
    assert special == 1 and pretokens[0] == "a"
    token_counts._learn("byte_bpe_50k.json", lexicon, set(pretokens))
    assert lexicon[" bb"] >= 1


def test_pattern_agrees_with_the_library_on_all_assigned_characters():
    from public_tokenizers import PATTERN
    from tokenizers import pre_tokenizers
    import regex

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    words = regex.compile(PATTERN).findall
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    for i in range(0, len(known), 2048):
        text = "".join(f"a{c}a 1{c}1 !{c}! {c}  " for c in known[i:i + 2048])
        assert [text[a:b] for _, (a, b) in cut(text)] == words(text)


def test_alphabet_is_the_library_s():
    from tokenizers import pre_tokenizers

    assert set(token_counts._alphabet().values()) == set(pre_tokenizers.ByteLevel.alphabet())


def fingerprint(text, k=4):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, threshold):
    """Smallest key reachable, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [(k, f"{p:016x}", least.get(root(i))) for i, (k, p) in enumerate(prints)]


def test_near_groups(spark):
    docs = documents(spark)
    prints = [(r.doc_id, fingerprint(r.text)) for r in docs.collect() if r.doc_id != 103]
    got = pairs(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id")
    assert [x for x in got if x[0] != 103] == sorted(groups(prints, 4), key=repr)
    assert simhash.near_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("cell", [4, 8192])
def test_links_join_all_pairs_within_four_bits(spark, monkeypatch, cell):
    """Clusters of near fingerprints of every distance, also with anchors cut into many cells."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    prints = []
    for c in range(12):
        centre = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(25):
            x = centre
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp bigint"), 4)
    found = {tuple(sorted(((r.u % 2**64), (r.v % 2**64)))) for r in links.collect()}
    assert all((u ^ v).bit_count() <= 64 for u, v in found)
    index = {x: i for i, x in enumerate(prints)}
    from pagesheaf.llm.components import components

    roots = {r.node % 2**64: r.root for r in components(links).collect()}
    want = groups([(i, x) for i, x in enumerate(prints)], 4)
    by_want, by_got = {}, {}
    for i, _, c in want:
        by_want.setdefault(c, set()).add(i)
    for x in prints:
        by_got.setdefault(roots.get(x, ("own", x)), set()).add(index[x])
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_every_syndrome_has_the_same_number_of_anchors():
    assert set(Counter(s for s, _ in simhash.patterns(1)).values()) == {1}
    assert set(Counter(s for s, _ in simhash.patterns(3)).values()) == {156}


def test_patterns_need_no_python_workers(spark):
    rows = [(0, 3, 5), (1, 2, 1 << 30)]
    table = simhash._pattern_table(spark, rows)
    assert [tuple(r) for r in table.collect()] == rows
    assert table.schema.simpleString() == "struct<side:int,syn:int,err:bigint>"
    assert "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()


def test_keep_one(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    want = {c for _, _, c in groups([(r.doc_id, fingerprint(r.text)) for r in docs.collect()], 4)}
    assert set(ids) - {None} == want - {None} and max(ids[i] for i in want) == 1


def test_components_of_a_long_path_and_a_star(spark):
    from pagesheaf.llm.components import components

    path = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, i) for i in range(1001, 1200)]
    links = spark.createDataFrame(path + star + [(5, 5)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1200)}
    assert components(links.limit(0)).count() == 0


def scan(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    places, base = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    labels, share = set(base), 0.0
    for label, template in licenses.TEMPLATES:
        t = set(template.split())
        for i in range(0, max(len(words), 1), licenses.STEP):
            n = len(t & set(words[i:i + licenses.BLOCK]))
            if n >= math.ceil(licenses.THRESHOLD * len(t) - 1e-9):
                labels.add(label)
                share = max(share, n / len(t))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), 1.0 if places else share)


def test_license_scan(spark):
    extra = [
        (200, "All  rights, RESERVED cc-by CC by 4.0"), (201, "cc by cc by the General public license"), (201, "cc by cc by"),
        (202, "lİcense the mit Kelvin license: reléased under released the"), (203, prose(4, 50) + " Released under the MIT License. " + prose(5, 90)),
        (204, "permission is granted hereby, free of charge, to any person obtaining a copy of the software, this one"),
        (205, "all rights all rights reserved"), (206, "cc bye all right reserved general public licenses"),
        (207, "licensed under the Apache License, Version 2.0; mit " * 40),
    ]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    want = sorted(((r.doc_id, *scan(r.text)) for r in docs.collect()), key=repr)
    assert pairs(licenses.license_scan(docs), *columns) == want
    assert licenses.license_scan(empty(spark)).count() == 0
    assert licenses.license_scan(documents(spark)).count() == documents(spark).count()
