"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored

# Permitted sequence lengths, in tokens. A training step's cost of a sequence: a fixed part, a part for each token, and
# attention, which grows with the square of the length and equals the part for the tokens at ATTENTION tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD, ATTENTION = 64.0, 32_768.0
# Pieces that one task packs; more pieces make more tasks.
SHARD_PIECES = 50_000


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


def _pack_with(sizes: list[int], opened: dict[int, int], lengths: tuple[int, ...]) -> tuple[float, list[int], list[int], list[int]]:
    """Best fit of sizes in falling order, where a new bin for a piece has the length ``opened`` names.

    (total cost after downsizing, bin of each piece, its start in the bin, length of each bin).
    """
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    free = 0  # bit r is set if some bin has exactly r tokens of room left
    bins, starts, caps, used = [], [], [], []
    for s in sizes:
        fits = free >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room = opened[s]
            b = len(caps)
            caps.append(room)
            used.append(0)
        bins.append(b)
        starts.append(used[b])
        used[b] += s
        left = room - s
        if left:
            if not rooms[left]:
                free |= 1 << left
            rooms[left].append(b)
    down = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return float(sum(map(cost, down.tolist()))), bins, starts, down.tolist()


def pack_sizes(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, start, length of the bin) of each piece.

    The permitted lengths are optimised together: for each of them the pieces are packed once with new bins of at least
    that length, once more with new bins of the least cost per token among those that hold the piece; every bin is then
    cut down to the shortest permitted length that holds its contents, and the cheapest packing is kept.
    """
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    holds = {s: [c for c in lengths if c >= s] for s in set(falling)}
    rules = [{s: max(h[0], floor) for s, h in holds.items()} for floor in lengths]
    rules.append({s: min(h, key=lambda c: cost(c) / c) for s, h in holds.items()})
    best = min((_pack_with(falling, rule, lengths) for rule in rules), key=lambda p: p[0])
    out = np.zeros((3, len(sizes)), np.int64)
    out[0, order], out[1, order] = best[1], best[2]
    out[2] = np.array(best[3], np.int64)[out[0]] if len(sizes) else 0
    return out[0], out[1], out[2]


def pack(units: DataFrame, lengths: tuple[int, ...] = LENGTHS, separator: int = 1) -> DataFrame:
    """Pack rows (doc_id, n_tokens) into sequences.

    Returns rows (doc_id, n_tokens, piece, piece_start, piece_tokens, bin_id, bin_length, bin_start): one per piece. A
    document takes ``n_tokens`` plus ``separator`` tokens; one longer than the longest permitted length is cut into
    pieces of that length and a rest. Nothing is dropped: a document without tokens is a piece of the separator alone, null
    counts as no tokens, repeated rows and null ids are packed like others. ``piece_tokens`` holds the separator, at the
    end of the last piece. An empty table gives no rows.

    Rows are dealt by their number in the stored table to tasks of about ``SHARD_PIECES`` pieces, whatever their ids or
    sources, and each task packs its own; a bin never spans tasks. At that size what the cut costs is below one bin per task.
    """
    lengths, longest = tuple(sorted(lengths)), max(lengths)
    whole = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint")
    kept = stored(units.select("doc_id", whole.alias("n_tokens")), "packing-units")
    size = F.col("n_tokens") + separator
    pieces = kept.agg(F.coalesce(F.sum(F.ceil(size / longest)), F.lit(0))).first()[0]
    shards = max(1, -(-int(pieces) // SHARD_PIECES))
    # The stored files are read the same way each time, so a repeated task numbers its rows as the first one did.
    numbered = kept.withColumn("row", F.monotonically_increasing_id())
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(size / longest) - 1, F.lit(0)).cast("int"))
    cut = numbered.select("doc_id", "n_tokens", "row", F.explode(numbers).alias("piece"))
    start = F.col("piece").cast("bigint") * longest
    cut = cut.withColumns({"piece_start": start, "piece_tokens": F.least(F.lit(longest).cast("bigint"), size - start)})
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    schema = "doc_id bigint, n_tokens bigint, piece int, piece_start bigint, piece_tokens bigint, bin_id bigint, bin_length int, bin_start int"

    def run(pdf: pa.Table) -> pa.Table:
        table = pdf.sort_by([("row", "ascending"), ("piece", "ascending")])
        bins, starts, caps = pack_sizes(table["piece_tokens"].to_numpy().astype(np.int64), lengths)
        shard = table["shard"][0].as_py()
        return pa.table({
            **{c: table[c] for c in ("doc_id", "n_tokens", "piece", "piece_start", "piece_tokens")},
            "bin_id": pa.array((shard << 32) + bins, pa.int64()),
            "bin_length": pa.array(caps, pa.int32()), "bin_start": pa.array(starts, pa.int32()),
        })

    return cut.groupBy("shard").applyInArrow(run, schema)
