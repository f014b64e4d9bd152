"""Approximate nearest neighbours by a hash-prefix forest.

A tree hashes a vector to a string of ``BITS`` bits, the sides of randomly turned planes on which it lies; nearer vectors
share longer prefixes. The strings of a tree, sorted, form a prefix tree: a node that holds more than a share of all vectors
is split by the next bit, so leaves are ranges of the sorted strings with prefixes of various lengths. A query descends to
its longest prefix match in every tree and then ascends in all trees together, one bit at a time: the leaves of all
trees are visited by falling length of the prefix they share with the query's string, until those visited hold enough
strings. Every vector of a visited leaf is a candidate; products of all candidates are computed and the best are kept.

How many strings are enough is measured for each table, by one rule at every size: a bounded sample of the queries is compared with all
vectors, and the ascent goes as far as it takes to reach ``RECALL`` of the sample's true neighbours. Tables whose vectors
have near neighbours need few strings; where all vectors are about equally far, no hash helps, and it finds that out.

For the largest inner product, vectors get one more coordinate that gives all of them the same length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored

# Bits of a string, and by how many the tree is made deeper with one count of the strings.
TREES, BITS, STEP, SEED = 12, 30, 6, 5
# A node with more than this share of all vectors is split while its strings have bits left.
LEAF_SHARE = 1 / 1024
# Leaves that a query visits at most, about: where it needs more strings than so many leaves hold, leaves are made larger.
VISITS = 32
# Part of the true neighbours that the ascent must reach, and queries of the sample on which that is measured.
RECALL, SAMPLE = 0.95, 200
# Vectors of a leaf that meet in one array; a leaf with more, of equal vectors say, is dealt over several.
SLICE = 20_000
# Rows that a task of the search should hold, and queries whose products it computes at a time.
TASK_ROWS, BLOCK = 100_000, 256


def usable(vector: str) -> Column:
    """True for vectors without null and non-finite components that aren't zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _planes(dims: int) -> list[np.ndarray]:
    """Normals of the planes of every tree, at right angles as far as there are dimensions."""
    out = []
    for tree in range(TREES):
        rng = np.random.default_rng([SEED, tree, dims])
        turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-BITS // dims))]
        out.append(np.concatenate(turns, axis=1)[:, :BITS])
    return out


def _codes(x: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """Strings of all vectors as numbers, one column for each tree."""
    weights = 2.0 ** np.arange(BITS - 1, -1, -1)
    return np.stack([(x @ p > 0) @ weights for p in planes], axis=1).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dims)


def _padded(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of one length: the missing square goes to a coordinate of its own."""
    x = x / longest
    rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def _asked(x: np.ndarray) -> np.ndarray:
    """Vectors of queries: of length one, with nothing in the coordinate that evens out lengths."""
    return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)


def _leaves(strings: DataFrame, total: int, share: float) -> np.ndarray:
    """Rows (tree, first string, bits of the prefix, vectors) of every leaf, in order.

    A level has at most ``TREES / share`` nodes that are split, and ``STEP`` levels are counted at a time, so at most
    ``2 ** STEP`` times as many counts reach the driver, whatever the table holds.
    """
    most = max(total * share, 1)
    out: list[tuple[int, int, int, int]] = []
    inside = strings
    for depth in range(STEP, BITS + 1, STEP):
        level = inside.withColumn("node", F.expr(f"shiftleft(shiftright(code, {BITS - depth}), {BITS - depth})"))
        left = {(r.tree, r.node): r.n for r in level.groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()}
        for bits in range(depth - STEP + 1, depth + 1):
            sums: Counter[tuple[int, int]] = Counter()
            for (tree, node), n in left.items():
                sums[tree, node >> BITS - bits << BITS - bits] += n
            done = {at for at, n in sums.items() if n <= most or bits == BITS}
            out += [(tree, node, bits, sums[tree, node]) for tree, node in done]
            left = {(t, node): n for (t, node), n in left.items() if (t, node >> BITS - bits << BITS - bits) not in done}
        if not left:
            break
        # Bounded by the share: these are the nodes that hold more than it.
        split = strings.sparkSession.createDataFrame(sorted(left), "tree int, node bigint")
        inside = level.join(F.broadcast(split), ["tree", "node"]).select("tree", "code", "n")
    return np.array(sorted(out), np.int64)


def _ascent(codes: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the strings of each query: the leaves in the order of their visit, and the strings held by those before."""
    tree, first, depth, held = leaves.T
    # The length of a number in bits, which tells where two strings part.
    part = np.frexp((codes[:, tree] ^ first).astype(np.float64))[1]
    shared = np.minimum(BITS - part, depth)
    order = np.argsort(-shared, axis=1, kind="stable")
    return order, np.cumsum(held[order], axis=1) - held[order]


def _leaf_of(codes: np.ndarray, leaves: np.ndarray, tree: int) -> np.ndarray:
    own = np.nonzero(leaves[:, 0] == tree)[0]
    return own[np.searchsorted(leaves[own, 1], codes[:, tree], "right") - 1]


def _sampled(rows: DataFrame, dims: int, longest: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a bounded sample of the queries: their strings, and of every true neighbour the query's place and its strings."""
    sample = rows.where("query").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "vec").collect()
    if not sample:
        return np.zeros((0, TREES), np.int64), np.zeros(0, np.int64), np.zeros((0, TREES), np.int64)
    ids, x = np.array([r.vec_id for r in sample], np.int64), np.array([r.vec for r in sample], np.float64)
    shared = rows.sparkSession.sparkContext.broadcast((ids, x))

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        planes = _planes(dims + 1)
        best: tuple[np.ndarray, ...] | None = None
        for b in batches:
            vec, names = _matrix(b.column(1), dims), b.column(0).to_numpy()
            score = asked @ vec.T
            score[own[:, None] == names[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            codes = _codes(_padded(vec, longest), planes)
            found = (np.take_along_axis(score, top, 1), names[top], codes[top])
            if best is not None:
                found = tuple(np.concatenate(z, axis=1) for z in zip(best, found))
                top = np.argsort(-found[0], axis=1, kind="stable")[:, :k]
                found = tuple(z[np.arange(len(top))[:, None], top] for z in found)
            best = found
        if best is not None:
            q, at = np.nonzero(np.isfinite(best[0]))
            codes = pa.FixedSizeListArray.from_arrays(pa.array(best[2][q, at].ravel()), TREES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(best[0][q, at]), pa.array(best[1][q, at]), codes], ["q", "score", "vec_id", "codes"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    each = rows.select("vec_id", "vec").mapInArrow(closest, "q int, score double, vec_id bigint, codes array<bigint>")
    true = each.withColumn("r", rank).where(F.col("r") <= k).select("q", "codes").collect()
    codes = np.array([r.codes for r in true], np.int64).reshape(len(true), TREES)
    return _codes(_asked(x), _planes(dims + 1)), np.array([r.q for r in true], np.int64), codes


def _enough(asked: np.ndarray, who: np.ndarray, codes: np.ndarray, leaves: np.ndarray, k: int, recall: float) -> int:
    """Strings that visited leaves must hold, so that the sample's ``k`` true neighbours are reached to the part ``recall``.

    It is never fewer than hold ``k`` vectors besides the query, each with a string in every tree.
    """
    least = TREES * (k + 1)
    if not len(who):
        return least
    order, before = _ascent(asked, leaves)
    reached = np.empty_like(before)
    np.put_along_axis(reached, order, before, axis=1)
    cost = np.min([reached[who, _leaf_of(codes, leaves, t)] for t in range(TREES)], axis=0)
    return max(int(np.quantile(cost, recall, method="higher")) + 1, least)


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest products of each query, each candidate once: query, rank from 0, candidate and product, in order."""
    order = np.lexsort((-s, c, q))
    q, c, s = q[order], c[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, s = q[new], c[new], s[new]
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    starts = np.nonzero(np.concatenate(([True], q[1:] != q[:-1])))[0]
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    top = rank < k
    return q[top], rank[top], c[top], s[top]


def nearest(
    vectors: DataFrame, query: Column | None = None, k: int = 20, recall: float = RECALL,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest found of every query, by inner product in double precision.

    Queries are the rows for which ``query`` holds, by default those whose key is divisible by 20; candidates are all rows
    but the query's own. Ties go to the smaller key. A query with fewer than ``k`` candidates has them all. Vectors that
    are null, zero, or hold null or non-finite components, rows without a key, and vectors whose length isn't the most
    frequent one take no part. Of rows that share a key the smallest vector counts. Without any vector left there are no
    rows; other columns are not read. The ascent reaches the part ``recall`` of the neighbours of a sample.
    """
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("vec_id"))
    rows = rows.agg(F.min(vector).alias("vec"))
    is_query = (F.col("vec_id") % 20 == 0) if query is None else query
    rows = stored(rows.select("vec_id", "vec", is_query.alias("query")), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    found = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"), F.count_if("query").alias("asks"), F.max(square).alias("square"))
    found = found.orderBy(F.desc("n"), "dims").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    if found is None:
        return spark.createDataFrame([], result)
    dims, total, longest = found.dims, found.n, float(np.sqrt(found.square))
    rows = rows.where(F.size("vec") == dims)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _planes(dims + 1)
        for b in batches:
            codes = _codes(_padded(_matrix(b.column(0), dims), longest), planes)
            for t in range(TREES):
                values, n = np.unique(codes[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(values), t), pa.int32()), pa.array(values), pa.array(n, pa.int64())], ["tree", "code", "n"])

    hashed = rows.select("vec").mapInArrow(strings, "tree int, code bigint, n bigint")
    hashed = stored(hashed.groupBy("tree", "code").agg(F.sum("n").alias("n")), "strings")
    sample = _sampled(rows, dims, longest, k)
    found_leaves = _leaves(hashed, total, LEAF_SHARE)
    wanted = _enough(*sample, found_leaves, k, recall)
    larger = wanted / total / VISITS
    if larger > LEAF_SHARE:
        found_leaves = _leaves(hashed, total, larger)
        wanted = _enough(*sample, found_leaves, k, recall)
    shared = spark.sparkContext.broadcast(found_leaves)

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared.value
        slices = -(-leaves[:, 3] // SLICE)
        planes = _planes(dims + 1)

        def out(at, leaf, piece, is_query, b):
            return pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(piece, pa.int32()), pa.array(np.full(len(at), is_query)),
                 b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["leaf", "slice", "query", "vec_id", "vec"])

        for b in batches:
            vec = _matrix(b.column(1), dims)
            ids = b.column(0).to_numpy()
            every = np.arange(len(vec))
            codes = _codes(_padded(vec, longest), planes)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            for t in range(TREES):
                leaf = _leaf_of(codes, leaves, t)
                yield out(every, leaf, spread % slices[leaf], False, b)
            asks = np.nonzero(b.column(2).to_numpy(zero_copy_only=False))[0]
            for i in range(0, len(asks), BLOCK):
                at = asks[i:i + BLOCK]
                order, before = _ascent(_codes(_asked(vec[at]), planes), leaves)
                who, place = np.nonzero(before < wanted)
                leaf = order[who, place]
                n = slices[leaf]
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield out(np.repeat(at[who], n), np.repeat(leaf, n), piece, True, b)

    kind = dict(rows.dtypes)["vec"]
    dealt = rows.select("vec_id", "vec", "query").mapInArrow(seats, f"leaf int, slice int, query boolean, vec_id bigint, vec {kind}")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * TREES * 2 // TASK_ROWS))
    dealt = dealt.repartition(tasks, "leaf", "slice")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        seat = t["leaf"].to_numpy().astype(np.int64) * (1 << 31) + t["slice"].to_numpy()
        asks, ids = t["query"].to_numpy(), t["vec_id"].to_numpy()
        x = _matrix(t["vec"].combine_chunks() if t["vec"].num_chunks > 1 else t["vec"].chunk(0), dims)
        order = np.lexsort((ids, asks, seat))
        cuts = np.nonzero(np.diff(seat[order]))[0] + 1
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for group in np.split(order, cuts):
            qs, cs = group[asks[group]], group[~asks[group]]
            if not len(cs):
                continue
            small = x[cs].astype(np.float32)
            for i in range(0, len(qs), BLOCK):
                at = qs[i:i + BLOCK]
                rough = x[at].astype(np.float32) @ small.T
                rough[ids[at][:, None] == ids[cs][None, :]] = -np.inf
                cut = np.partition(rough, max(len(cs) - k, 0), axis=1)[:, max(len(cs) - k, 0)]
                # Single precision only sorts out; what is within its error of the k-th best is computed in double.
                slack = 1e-5 * np.linalg.norm(x[at], axis=1) * longest
                r, c = np.nonzero((rough >= (cut - slack)[:, None]) & np.isfinite(rough))
                best.append((ids[at][r], ids[cs][c], np.einsum("ij,ij->i", x[at][r], x[cs][c])))
        if not best:
            return
        q, _, c, s = _best(*(np.concatenate(z) for z in zip(*best)), k)
        # One row for each query, so that few rows go to the merge.
        starts = np.nonzero(np.concatenate(([True], q[1:] != q[:-1])))[0]
        ends = pa.array(np.append(starts, len(q)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(z)) for z in (c, s)]
        yield pa.RecordBatch.from_arrays([pa.array(q[starts]), *lists], ["query_id", "vec_ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t["vec_ids"].combine_chunks()
        n = pc.list_value_length(ids).to_numpy()
        scores = t["scores"].combine_chunks().flatten().to_numpy()
        q, rank, c, s = _best(np.repeat(t["query_id"].to_numpy(), n), ids.flatten().to_numpy(), scores, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array((rank + 1).astype(np.int32)), pa.array(c), pa.array(s)], ["query_id", "rank", "vec_id", "score"])

    # A query has one row from each task that holds a leaf it visits.
    merges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.asks * VISITS // TASK_ROWS))
    each = dealt.mapInArrow(search, "query_id bigint, vec_ids array<bigint>, scores array<double>").repartition(merges, "query_id")
    return each.mapInArrow(merge, result)
