"""SimHash near-duplicates: fingerprints of word shingles, linked by anchor-point covering.

The 64 bits of a fingerprint are cut into two halves of 31 bits (the two bits left over never serve as a key). If two
fingerprints differ in at most ``t`` bits, they differ in at most ``t // 2`` bits of the left half or in at most
``t - t // 2 - 1`` of the right one. The anchors of a half are the 2^26 words of the Hamming code of length 31:
every 31-bit word is within the covering radius 1 of exactly one anchor, its home. Of two words that differ in at most
``h`` bits, the second is within ``1 + h`` of the first one's home. So a fingerprint goes to its home and is replicated to
every anchor within covering radius plus the threshold of the half, and only fingerprints that meet at an anchor are
compared, on all 64 bits. For ``t = 4`` that is 156 anchors on the left and 16 on the right, for every fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored
from pagesheaf.llm.components import components

HALF = 31
RADIUS = 1
SEED = 42
# Home fingerprints of one anchor that one cell of the comparison holds; an anchor with more is cut into cells.
CELL = 8192
# Rows of replicas that one task of the comparison should hold.
TASK_ROWS = 1_000_000
_BLOCK = 1 << 16
_COPY, _HOME, _BOTH = 1, 2, 3


def _fingerprint(text: str | None, shingle: int) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    starts, ends = starts.tolist(), ends.tolist()
    total, counts = len(starts), np.zeros(64, np.int64)
    for i in range(0, total, _BLOCK):
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i:i + _BLOCK], ends[i:i + _BLOCK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # One-byte sums of 255 rows at a time are several times faster than wide sums of single bits.
        for j in range(0, len(bits), 255):
            counts += np.add.reduce(bits[j:j + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (key, fp) per row of ``docs``; ``fp`` is the fingerprint as a signed 64-bit number.

    ASCII letters are lower-cased, words are runs of characters other than space and the controls 9 to 13. Fewer words
    than ``shingle`` make one shingle, no words (or null) the fingerprint 0.
    """
    schema = docs.select(F.col(key), F.lit(0).cast("bigint").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [_fingerprint(x.as_py(), shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


def _columns() -> list[int]:
    """Column ``i`` of the parity check matrix is the number ``i + 1``; a syndrome has five bits."""
    return list(range(1, HALF + 1))


def syndrome(word: Column) -> Column:
    cols = _columns()
    total = F.lit(0)
    for j in range(5):
        mask = sum(1 << i for i, c in enumerate(cols) if c >> j & 1)
        total = total + F.shiftleft((F.bit_count(word.bitwiseAND(F.lit(mask))) % 2).cast("int"), j)
    return total


def patterns(distance: int) -> list[tuple[int, int]]:
    """Pairs (syndrome, error pattern): adding the pattern to a word of that syndrome gives an anchor."""
    out = []
    for weight in range(distance + 1):
        for bits in combinations(range(HALF), weight):
            s = 0
            for b in bits:
                s ^= _columns()[b]
            out.append((s, sum(1 << b for b in bits)))
    return out


def _half(fp: Column, side: int) -> Column:
    return F.shiftrightunsigned(fp, HALF * side).bitwiseAND(F.lit((1 << HALF) - 1))


def _links_of_task(homes: tuple, reps: tuple, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all links between homes and replicas of equal keys."""
    (hk, hf), (rk, rf) = homes, reps
    order = np.argsort(hk, kind="stable")
    hk, hf = hk[order], hf[order]
    lo, hi = np.searchsorted(hk, rk, "left"), np.searchsorted(hk, rk, "right")
    met = hi > lo
    lo, n, rf = lo[met], (hi - lo)[met], rf[met]
    names, ids = np.unique(np.concatenate((hf, rf)), return_inverse=True)
    hid, rid = ids[: len(hf)], ids[len(hf):]
    label = np.arange(len(names))
    step, i = 1 << 21, 0
    ends = np.cumsum(n)
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + step, "right")))
        m = n[i:j]
        at = np.repeat(np.arange(i, j), m)
        h = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m) + lo[at]
        a, b = hid[h], rid[at]
        near = np.bitwise_count(hf[h] ^ rf[at]) <= threshold
        a, b = a[near], b[near]
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        i = j
    own = np.nonzero(label != np.arange(len(names)))[0]
    return names[label[own]], names[own]


def _pattern_table(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """Rows (side, syn, err). From Arrow: a list of rows would start Python workers of another kind beside those of the
    other stages, and both stay."""
    types = {"side": pa.int32(), "syn": pa.int32(), "err": pa.int64()}
    return spark.createDataFrame(pa.table({c: pa.array(x, t) for (c, t), x in zip(types.items(), zip(*rows))}))


def near_links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp``; they span the components of all pairs within ``threshold``.

    Links between different fingerprints only, at most one per fingerprint and task, so a group of many near copies
    gives links in proportion to its size. An anchor that more than ``CELL`` fingerprints call home is cut into slices;
    every slice of its homes meets every slice of its replicas in a cell of its own.
    """
    spark = fps.sparkSession
    left = threshold // 2
    rows = [(0, s, e) for s, e in patterns(RADIUS + left)]
    rows += [(1, s, e) for s, e in patterns(RADIUS + max(threshold - left - 1, 0))]
    # The tables of patterns depend on the threshold alone: 32 x (156 + 16) rows for 4 bits.
    table = F.broadcast(_pattern_table(spark, rows))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), _half(F.col("fp"), s).alias("part")) for s in (0, 1)]))
    n = fps.count()
    tasks = max(1, -(-n * len(rows) // 32 // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Every fingerprint becomes some 172 rows, so what one task reads must be few fingerprints and not one file split.
    parts = fps.select("fp").repartition(tasks, "fp").select("fp", sides.alias("x")).select("fp", "x.*")
    parts = parts.withColumn("syn", syndrome(F.col("part")))
    place = (F.col("side").cast("bigint") * (1 << HALF)).bitwiseOR(F.col("part").bitwiseXOR(F.col("err")))
    copies = parts.join(table, ["side", "syn"]).select("fp", place.alias("anchor"), F.bit_count("err").alias("d"))
    home = parts.join(table.where(F.bit_count("err") <= RADIUS), ["side", "syn"]).select(place.alias("anchor"))
    wide = home.groupBy("anchor").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("cells > 1")
    wide = stored(wide, "wide-anchors")
    met = copies.join(wide, "anchor", "left")
    # A seat is an anchor, a slice of its homes, a slice of its replicas and a role, in one number.
    mine = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("bigint")
    all_cells = F.sequence(F.lit(0).cast("bigint"), F.col("cells").cast("bigint") - 1)
    near_home = F.col("d") <= RADIUS
    in_one = F.array(F.when(near_home, _BOTH).otherwise(_COPY).cast("bigint"))
    as_copy = F.transform(all_cells, lambda i: i * (1 << 16) + mine * 4 + _COPY)
    as_home = F.transform(all_cells, lambda j: mine * (1 << 16) + j * 4 + _HOME)
    seats = F.when(F.col("cells").isNull(), in_one).when(near_home, F.concat(as_home, as_copy)).otherwise(as_copy)
    seated = met.select("fp", "anchor", F.explode(seats).alias("s"))
    dealt = seated.select("fp", (F.col("anchor") * (1 << 30) + F.col("s")).alias("seat")).repartition(
        tasks, F.shiftright("seat", 2))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, seats = [], []
        for b in batches:
            fps.append(b.column(0).to_numpy().view(np.uint64))
            seats.append(b.column(1).to_numpy())
        if not fps:
            return
        fp, seat = np.concatenate(fps), np.concatenate(seats)
        home, copy = (seat & _HOME) > 0, (seat & _COPY) > 0
        u, v = _links_of_task((seat[home] >> 2, fp[home]), (seat[copy] >> 2, fp[copy]), threshold)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(compare, "u bigint, v bigint")


def near_groups(docs: DataFrame, shingle: int = 4, threshold: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, fingerprint, component_id), one per row of ``docs``.

    ``fingerprint`` is the fingerprint in 16 lower-case hexadecimal digits, ``component_id`` the smallest key that links
    of at most ``threshold`` differing bits reach. Equal fingerprints are one node, so thousands of copies cost one row
    per task in the exchange. Null and blank texts share fingerprint zero and so one component. Repeated rows stay
    repeated; a null key is kept but never names a component, unless the component has no other (then null). An empty
    table gives no rows. Other columns are not read.
    """
    fps = stored(fingerprints(docs, shingle, text, key), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min(key).alias("least")), "fingerprint-nodes")
    roots = stored(components(near_links(nodes.select("fp"), threshold)), "fingerprint-roots")
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(smallest, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(named, "fp").select(key, digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, threshold: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the row with the smallest ``doc_id``.

    Repeated rows of that id are reduced to one. Only ids are joined; a text moves only where its id occurs more than
    once. Rows without an id can't be told apart and are all kept.
    """
    ids = near_groups(docs, shingle, threshold).where("doc_id = component_id")
    counted = stored(ids.groupBy("doc_id").agg(F.count("*").alias("copies")), "kept-ids")
    # The row travels as one column, so that no name of its own can clash.
    rows = docs.select(F.struct("*").alias("row"), "doc_id")
    # The kept ids grow with the table, so they are joined by a shuffle at every size and never broadcast.
    kept = rows.join(counted.hint("merge"), "doc_id")
    once = kept.where("copies = 1").select("row")
    more = kept.where("copies > 1").dropDuplicates(["doc_id"]).select("row")
    return once.union(more).union(rows.where("doc_id is null").select("row")).select("row.*")
