"""The conversation trie against lists of prefixes, and the z-fast trie against a plain walk."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from compare import connect, differences

from pagesheaf.llm import oracles, queries, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, name string, path int, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def force(rows):
    """All prefixes as tuples of turns."""
    said = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            said[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [v[3:] for v in sorted(t)] for c, t in said.items()}
    whole = {}
    for c, t in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    out = []
    for k, m in members.items():
        below = [q for q in members if q[:len(k)] == k]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]),
                    sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tangled():
    """Nulls in every column, equal turns and rows, negative ids, missing first conversations, turnless ones."""
    rng = random.Random(3)
    rows = [(c if c < 140 else -c, rng.choice([None, k, k, k]), rng.choice(["u", None, "a"]), rng.choice(["x", "y y", None, "", "z\tz"]))
            for c in range(150) for k in range(rng.randrange(7))]
    return [*rows, (None, 1, "u", "x"), *rows[:5]]


def long_chains():
    return [(c, k, "u", "w " * (k % 3) + ("q" if k > c % 9 else "")) for c in range(100) for k in range(c % 13)] + [(500, k, "u", str(k)) for k in range(700)]


@pytest.mark.parametrize("crown, size", [(100, 20_000), (1, 20_000), (3, 5)])
@pytest.mark.parametrize("case", [tangled, long_chains, list])
def test_prefixes(spark, case, crown, size):
    rows = case()
    df = spark.createDataFrame([(*r, "name", 1, "n") for r in rows], SCHEMA)
    found = trie.conversation_trie(df, crown_at=crown, trie_size=size, batch=min(size, 7) if size < 100 else 1000)
    assert found.columns == COLUMNS
    want = force(rows[:-700]) if case is long_chains else force(rows)
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    if case is long_chains:
        # The long conversation adds a chain of its own behind the root and what it shares.
        assert len([g for g in got if g[0] == 500]) >= 690 and sum(r[3] for r in got if r[1] == 0) == 93
        got = [g for g in got if g[0] != 500 and g[1]]
        want = [w for w in want if w[1]]
        assert [g[:6] for g in got] == [w[:6] for w in want] and [g[7] for g in got] == [w[7] for w in want]
    else:
        assert got == want


def test_query_against_sql(spark):
    assert differences(queries.op12_trie(spark, SF), connect(SF), oracles.ORACLES["op12_trie"]) is None


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 80):
            assert trie.two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


def test_handles_and_exit_nodes():
    """Every compacted node is found under the two-fattest depth of its edge, every path at its deepest whole node."""
    rng = random.Random(9)
    name = lambda turns: hashlib.sha256(repr(turns).encode()).digest()
    paths = [tuple(rng.choice("ab") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    paths += [p[:5] + tuple("c" * rng.randrange(60)) for p in paths[:50]]
    named = {p: [trie.ROOT, *(name(p[:i]) for i in range(1, len(p) + 1))] for p in set(paths)}
    made = trie.ZFastTrie()
    items = [(names, [1] * len(p), 1, i, None) for i, (p, names) in enumerate(named.items())]
    for i in range(0, len(items), 16):
        made.insert(items[i:i + 16])
    nodes = [n for n in made.nodes() if n.high]
    assert len(made.handles) == len(nodes)
    for node in nodes:
        assert made.handles[node.path[trie.two_fattest(node.low, node.high)]] is node
        assert node.parent.high == node.low and node.parent.children[node.path[node.low + 1]] is node
    strangers = [tuple(rng.choice("abc") for _ in range(30)) for _ in range(100)]
    for p in [*named, *strangers]:
        names = named.get(p) or [trie.ROOT, *(name(p[:i]) for i in range(1, len(p) + 1))]
        walked = made.root
        while walked.high < len(p):
            below = walked.children.get(names[walked.high + 1])
            if below is None or below.high > len(p) or below.path[below.high] != names[below.high]:
                break
            walked = below
        assert made.locate(names) is walked


def test_long_lists_are_hashed_in_pieces(spark, monkeypatch):
    members = spark.range(30_000).selectExpr("cast(if(id < 25000, 'a', concat('b', id)) as binary) AS name", "id * 3 AS conv_id")
    rows = {bytes(r.name): r.ends for r in trie.list_hashes(members).collect()}
    assert len(rows) == 5001
    assert rows[b"a"] == hashlib.sha256(",".join(str(3 * i) for i in range(25_000)).encode()).hexdigest()
    assert rows[b"b29999"] == hashlib.sha256(b"89997").hexdigest()
