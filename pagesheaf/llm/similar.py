"""Near copies by exact similarity: SimHash groups first, then every other pair of word-shingle sets by prefix filtering.

Fingerprints of five-word shingles are linked by anchor-point covering, and each fingerprint's set is compared with one set of
its group. Near copies of a Jaccard index of 0.8 differ in more bits than a covering reaches, so an exact step completes the
links: sets are put in one order of all shingles, frequent ones last. Two sets of at least ``similarity`` share one of the
first ``n - ceil(similarity * n) + 1`` shingles of each, so only sets that meet at such a shingle are compared. Every
pair is decided on its whole sets, unless sketches of some bytes show that they differ too much. Any order gives all pairs; the list of frequent shingles is there for speed alone.

Prefixes are exchanged once. Where few sets meet, all pairs of them are laid out. Where many meet, each is compared with the
middle one, and only those still in different components afterwards are paired in a second step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pagesheaf.llm.common import stored
from pagesheaf.llm.components import components
from pagesheaf.llm.simhash import fingerprints, near_links

# A shingle that stood in at least LATE of some LATE_TEXTS texts comes late in the order; the list is broadcast and holds
# those in more than LATE_SHARE of all rows, so it is bounded by the number of shingles of a text over that share.
LATE, LATE_TEXTS, LATE_SHARE = 3, 2_000, 1e-3
# Sets at one shingle from which they are first compared with one of them alone; pairs that one step lays out.
STAR, _STEP = 16, 1 << 18
# Words of sketches that are compared at once; slots of the map of sets whose texts move.
_WORDS, SLOTS = 1 << 19, 1 << 22
# Sets of one frequent shingle that one cell of the comparison holds, and pairs that a text is sent to one place for.
CELL, HUB = 4096, 64
# Bits of the fingerprints that the first links may differ in.
BITS = 3
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words and case as for fingerprints, no words give the empty set.

    A shingle's hash is a polynomial of its words' hashes, so that each word is hashed once.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - shingle + 1, 1)
    width = min(shingle, len(words))
    found = np.full(n, width, np.uint64)
    for j in range(width):
        found = found * _FACTOR + each[j:j + n]
    found ^= found >> np.uint64(31)
    return np.unique(found * _MIX)


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64))


def set_of(text: Column, shingle: int) -> Column:
    """Number of a text's shingle set."""

    @arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_node(shingle_set(t.as_py(), shingle)) for t in texts], pa.int64())

    return run(F.coalesce(text, F.lit("")))


def _late(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of frequent shingles, rows they were seen in), by rising frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, LATE_TEXTS):
                sets = [shingle_set(x.as_py(), shingle) for x in b.column(0)[k:k + LATE_TEXTS]]
                seen, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= LATE
                yield pa.RecordBatch.from_arrays([pa.array(seen[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

    least = max(LATE, LATE_SHARE * docs.count())
    counts = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).select("h", "n").toPandas().sort_values(["n", "h"])
    return found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)


def _prefix(hashes: np.ndarray, late: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    n = len(hashes)
    if len(late):
        at = np.minimum(np.searchsorted(late, hashes), len(late) - 1)
        hot = late[at] == hashes
        hashes = np.concatenate((hashes[~hot], hashes[hot][np.argsort(place[at[hot]])]))
    return hashes[: n - math.ceil(similarity * n - 1e-9) + 1]


class _Sketches:
    """Sketches of the sets of one task, those of one length as rows of 64-bit words; each is there folded to half its length as well."""

    def __init__(self, values: pa.Array) -> None:
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
        held = np.frombuffer(values.buffers()[2], np.uint8) if len(values) else np.zeros(0, np.uint8)
        self.words = (np.diff(ends) - 8) // 8
        self.size = held[ends[:-1, None] + np.arange(8)].view(np.int64).ravel()
        self.rows: dict[int, np.ndarray] = {}
        self.own, self.half = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for w in np.unique(self.words)[::-1].tolist():
            of = np.nonzero(self.words == w)[0]
            whole = held[ends[of, None] + 8 + np.arange(8 * w)].view(np.uint64)
            longer = self.rows.get(w, np.zeros((0, w), np.uint64))
            self.own[of] = np.arange(len(of)) + len(longer)
            self.rows[w] = np.concatenate((longer, whole))
            if w > 1:
                self.half[of], self.rows[w // 2] = np.arange(len(of)), whole[:, : w // 2] ^ whole[:, w // 2:]

    def may_be_similar(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """For pairs of sets what ``may_be_similar`` says of two of them; true where one is more than twice as long."""
        out = np.ones(len(i), bool)
        low, high = np.minimum(self.words[i], self.words[j]), np.maximum(self.words[i], self.words[j])
        most = (self.size[i] + self.size[j]) * (1 - similarity) / (1 + similarity) + 1e-6
        for w in np.unique(low).tolist():
            of = np.nonzero((low == w) & (high <= 2 * w))[0]
            for k in range(0, len(of), step := max(1, _WORDS // w)):
                at = of[k:k + step]
                x, y = (self.rows[w][np.where(self.words[z[at]] == w, self.own[z[at]], self.half[z[at]])] for z in (i, j))
                out[at] = np.bitwise_count(x ^ y).sum(axis=1) <= most[at]
        return out


class _Sets:
    """Sets that meet at the keys of one task: arrays of key, node, size, place of the shingle, component and slice."""

    def __init__(self, key, node, size, spot, label, part) -> None:
        order = self.order = np.lexsort((size, label, key))
        self.key, self.node, self.size, self.spot, self.label, self.part = (x[order] for x in (key, node, size, spot, label, part))
        edge = np.concatenate(([True], self.key[1:] != self.key[:-1])) if len(key) else np.zeros(0, bool)
        first = np.nonzero(edge)[0]
        count = np.diff(np.append(first, len(key)))
        self.start, self.n = np.repeat(first, count), np.repeat(count, count)
        # End of the run of equal components within a key.
        own = np.nonzero(edge | np.concatenate(([True], self.label[1:] != self.label[:-1])))[0] if len(key) else first
        self.end = np.repeat(np.append(own, len(key))[1:], np.diff(np.append(own, len(key)))) if len(key) else own

    def pairs(self, similarity: float, many: int | None = None, short: _Sketches | None = None) -> Iterator[np.ndarray]:
        """Pairs whose sizes, places and sketches allow the similarity: all of different components, or with the middle one alone
        at keys of ``many`` sets and more. In a cell of two slices only sets of different slices are paired."""
        at = np.arange(len(self.key))
        partner = self.start + self.n - self.end
        star = np.zeros(len(at), bool) if many is None else self.n >= many
        partner = np.where(star, 1, partner)
        ends, i = np.cumsum(partner), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _STEP, "right")))
            m = partner[i:j]
            a = np.repeat(at[i:j], m)
            b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + self.end[a]
            b = np.where(star[a], self.start[a] + self.n[a] // 2, b)
            small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
            # Needed overlap, against the shared ones that can come before this shingle and those from it on.
            need = np.ceil(similarity / (1 + similarity) * (small + large) - 1e-9)
            most = np.minimum(self.spot[a], self.spot[b]) + np.minimum(self.size[a] - self.spot[a], self.size[b] - self.spot[b])
            fits = (self.node[a] != self.node[b]) & (small >= similarity * large - 1e-9) & (most >= need)
            fits &= (self.part[a] < 0) | (self.part[a] != self.part[b])
            a, b = a[fits], b[fits]
            if short:
                near = short.may_be_similar(self.order[a], self.order[b], similarity)
                a, b = a[near], b[near]
            # The second one of a pair is the middle one of its key, so that it is the same for many.
            yield np.unique(np.stack((self.node[a], self.node[b])), axis=1)
            i = j


def _candidates(nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Rows (u, v) of pairs to decide where v is not null, otherwise (u, h, part, cells, size, spot) of sets at large keys."""
    late, seen = _late(nodes, shingle)
    by_hash = np.argsort(late)
    cells = np.maximum(1, -(-seen // CELL))
    shared = nodes.sparkSession.sparkContext.broadcast((late[by_hash], by_hash, cells[by_hash]))
    columns = ["h", "part", "cells", "node", "size", "spot"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, place, cut = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                sets = [shingle_set(x.as_py(), shingle) for x in b.column(0)[k:k + 1000]]
                parts = [_prefix(s, hashes, place, similarity) if len(s) else s for s in sets]
                m = np.array([len(p) for p in parts], np.int64)
                spots = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                own, sizes = np.repeat([_node(s) for s in sets], m), np.repeat([len(s) for s in sets], m)
                h = np.concatenate(parts)
                cell = np.ones(len(h), np.int32)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    cell = np.where(hashes[at] == h, cut[at], 1).astype(np.int32)
                arrays = [h.view(np.int64), (own % cell).astype(np.int32), cell, own.astype(np.int64), sizes.astype(np.int32), spots.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        h, part, cell, node, size, spot = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(6))
        # A slice of a frequent shingle is a key of its own here. Keys of one set give no pair, but a slice may meet others.
        key = h ^ (part.astype(np.int64) << 40)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        more = (count[back] > 1) | (cell > 1)
        h, part, cell, node, size, spot, key, n = (x[more] for x in (h, part, cell, node, size, spot, key, count[back]))
        none = pa.nulls
        for got in _Sets(key, node, size.astype(np.int64), spot.astype(np.int64), node, np.full(len(key), -1)).pairs(similarity, STAR):
            u, v = map(pa.array, got)
            yield pa.RecordBatch.from_arrays([u, v, none(len(u), pa.int64()), *[none(len(u), pa.int32())] * 4], schema=schema)
        far = (n >= STAR) | (cell > 1)
        u, h, *others = (pa.array(x[far]) for x in (node, h, part, cell, size, spot))
        yield pa.RecordBatch.from_arrays([u, none(len(u), pa.int64()), h, *others], schema=schema)

    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("h", pa.int64()), *((c, pa.int32()) for c in ("part", "cells", "size", "spot"))])
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = nodes.select("text").mapInArrow(prefixes, "h bigint, part int, cells int, node bigint, size int, spot int")
    met = index.repartition(tasks, "h", "part").mapInArrow(meet, "u bigint, v bigint, h bigint, part int, cells int, size int, spot int")
    return stored(met, "similar-candidates")


def _apart(large: DataFrame, roots: DataFrame, short: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of sets at large keys that are in different components and that their sketches allow. A key of many sets
    is cut into cells: every slice of it meets every other one in a cell of its own. The pairs of a key grow with its square,
    so they are compared where the sets meet: sketches move once for each set and key, and few pairs leave the task."""
    seated = large.join(roots.select(F.col("node").alias("u"), "root"), "u", "left").withColumn("label", F.coalesce("root", "u"))
    seated = seated.join(short.select(F.col("node").alias("u"), F.col("value").alias("sketch")).hint("merge"), "u")
    cell = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    seated = seated.select("h", "u", "size", "spot", "label", "part", "sketch", cell)
    seated = seated.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        h, node, size, spot, label, part, low, high = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(8))
        key = np.unique(np.stack((h, low.astype(np.int64) << 32 | high)), axis=1, return_inverse=True)[1].ravel()
        # Within one slice all are paired, which -1 says.
        sides = np.where(low == high, -1, part)
        found = _Sketches(pa.concat_arrays([b.column(8) for b in held]))
        for got in _Sets(key, node, size.astype(np.int64), spot.astype(np.int64), label, sides).pairs(similarity, short=found):
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["u", "v"])

    tasks = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seated.select("h", "u", "size", "spot", "label", "part", "low", "high", "sketch").repartition(tasks, "h", "low", "high").mapInArrow(run, "u bigint, v bigint")


def parity_sketch(hashes: np.ndarray) -> bytes:
    """One bit for each place ``h mod m``, set if an odd number of hashes falls there; m is the next power of two of their number, 64 at least.

    The exclusive or of two sketches is the sketch of what only one of the sets holds, so it has at most as many bits as that.
    """
    m = max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _least_apart(a: bytes, b: bytes) -> int:
    """Hashes that only one of two sets holds, at least. The longer sketch is folded to the length of the shorter one."""
    (x, n), (y, m) = ((int.from_bytes(z, "little"), 8 * len(z)) for z in sorted((a, b), key=len))
    while m > n:
        m //= 2
        y = y >> m ^ y & (1 << m) - 1
    return (x ^ y).bit_count()


def sketches(nodes: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, value): number of hashes of a set, in 8 bytes, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), shingle) for x in b.column(1)]
            values = [len(s).to_bytes(8, "little") + parity_sketch(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], ["node", "value"])

    return stored(nodes.select("node", "text").mapInArrow(run, "node bigint, value binary"), "set-sketches")


def may_be_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """False only for sets that are less similar: of all their hashes more than (1 - s) / (1 + s) are in one of them alone."""
    both = int.from_bytes(a[:8], "little") + int.from_bytes(b[:8], "little")
    return _least_apart(a[8:], b[8:]) <= both * (1 - similarity) / (1 + similarity) + 1e-6


def _compared(pairs: DataFrame, values: DataFrame, read: Callable, alike: Callable, label: str) -> DataFrame:
    """Those of the stored pairs (u, v) that are ``alike`` by what ``read`` makes of their values (node, value), stored.

    Values move twice: to the pairs, and from there to the place of a pair. The value of a ``v`` goes to one place for
    some ``HUB`` pairs, behind which the values of its ``u`` pass one by one.
    """
    places = pairs.groupBy("v").agg(F.ceil(F.count("*") / HUB).cast("int").alias("places"))
    dealt = pairs.join(places, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("places")).cast("int").alias("place"))
    each = dealt.select(F.col("u").alias("node"), "v", "place", F.lit(1).alias("turn"))
    hubs = dealt.select(F.col("v").alias("node"), "v", "place", F.lit(0).alias("turn")).distinct()
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = each.union(hubs).join(values.hint("merge"), "node").repartition(tasks, "v", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for b in batches:
            us, vs = [], []
            for i in range(b.num_rows):
                node, v, turn, value = (b.column(c)[i].as_py() for c in (0, 1, 3, 4))
                found = read(value)
                if not turn:
                    hub = found
                elif alike(hub, found):
                    us.append(node)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    ordered = met.select("node", "v", "place", "turn", "value").sortWithinPartitions("v", "place", "turn")
    return stored(ordered.mapInArrow(run, "u bigint, v bigint"), label)


def _of_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """The values (node, value) of the sets in ``pairs``, and a few more. Sets share the ``SLOTS`` bits of a map, which is what is
    broadcast, so it has a bound; values whose bit is not set are not exchanged."""
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    found = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).select(slot.alias("slot"))
    bits = found.groupBy(F.expr("slot div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    named = values.withColumn("slot", slot).withColumn("word", F.expr("slot div 64"))
    return named.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("node", "value")


def _verified(pairs: DataFrame, nodes: DataFrame, short: DataFrame | None, shingle: int, similarity: float, label: str) -> DataFrame:
    """Those of the pairs (u, v) whose whole sets have the similarity. Texts move only for pairs that their sketches allow;
    without ``short`` all of them do."""

    def alike(hub: np.ndarray, found: np.ndarray) -> bool:
        n = len(np.intersect1d(hub, found, assume_unique=True))
        return n >= similarity * (len(hub) + len(found) - n) - 1e-9

    pairs = stored(pairs.distinct(), label + "-pairs")
    possible = _compared(pairs, short, bytes, lambda a, b: may_be_similar(a, b, similarity), label + "-possible") if short else pairs
    texts = _of_pairs(nodes.select("node", F.col("text").alias("value")), possible)
    return _compared(possible, texts, lambda text: shingle_set(text, shingle), alike, label)


def fingerprint_pairs(nodes: DataFrame, shingle: int) -> DataFrame:
    """Pairs (u, v): every set with the first one of its group of near fingerprints, which anchor-point covering links."""
    prints = stored(fingerprints(nodes, shingle, key="node"), "set-fingerprints")
    roots = components(near_links(prints.select("fp").distinct(), BITS)).withColumnRenamed("node", "fp")
    grouped = prints.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    first = grouped.groupBy("root").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
    return grouped.join(first, "root").where("node <> v").select(F.col("node").alias("u"), "v")


def similar_links(nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) between numbers of sets of at least ``similarity``; they span the components of all such pairs.

    ``nodes`` has one row (node, text) for every distinct set.
    """
    found = _candidates(nodes, shingle, similarity)
    short = sketches(nodes, shingle)
    near = found.where("v is not null").select("u", "v").union(fingerprint_pairs(nodes, shingle))
    links = _verified(near, nodes, short, shingle, similarity, "near-links")
    roots = stored(components(links), "near-roots")
    rest = _apart(found.where("v is null").select("u", "h", "part", "cells", "size", "spot"), roots, short, similarity)
    return links.union(_verified(rest, nodes, None, shingle, similarity, "similar-links"))


def keep_one_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of every component of sets of at least ``similarity``.

    It is the one with the smallest ``doc_id``. Rows with equal sets are copies; rows of one id with different texts
    are told apart by their sets. Rows without an id are all kept. Null and blank texts have the empty set and are copies.
    """
    named = docs.select(F.struct("*").alias("row"), "doc_id", "text", set_of(F.col("text"), shingle).alias("node"))
    # Nulls come last, so that a set is named by an id if it has one.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("x")
    nodes = stored(named.groupBy("node").agg(least).select("node", "x.doc_id", "x.text"), "shingle-sets")
    roots = stored(components(similar_links(nodes, shingle, similarity)), "similar-roots")
    linked = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")
    kept = stored(linked.groupBy("root").agg(first).select("x.doc_id", "x.node").where("doc_id is not null"), "kept-sets")
    rows = named.select("row", "doc_id", "node").where("doc_id is not null")
    once = rows.join(kept.hint("merge"), ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select("row")
    return once.union(docs.where("doc_id is null").select(F.struct("*").alias("row"))).select("row.*")
