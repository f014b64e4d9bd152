"""The same decisions on a stream of page snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagesheaf import fixed
from pagesheaf.operators.chunks import chunk_key


SPREAD = 16


def _thin_copies(stream: DataFrame, keys: list[str], delay: str | None, spread: int) -> DataFrame:
    """Drop most copies of hot keys before they meet in one task.

    Copies of a key are spread over ``spread`` sub-keys and thinned there, so the exchange on the
    key itself carries at most ``spread`` rows of it.
    """
    salted = stream.withColumn("salt", F.pmod(F.xxhash64("ts"), F.lit(spread)))
    if delay is None:
        return salted.dropDuplicates([*keys, "salt"]).drop("salt")
    return salted.dropDuplicatesWithinWatermark([*keys, "salt"]).drop("salt")


def stream_first_chunks(chunk_stream: DataFrame, delay: str | None = "1 hour", spread: int = SPREAD) -> DataFrame:
    """First sighting of each chunk of a page.

    Within the watermark delay repeats are dropped; ``delay=None`` remembers every key for good.
    """
    keys = ["page_id", "key"]
    keyed = chunk_stream.where(F.coalesce("html", F.lit("")) != "").withColumn(
        "key", chunk_key(F.col("block_id"), F.col("html"))
    )
    if delay is None:
        return _thin_copies(keyed, keys, None, spread).dropDuplicates(keys)
    watermarked = keyed.withWatermark("ts", delay)
    return _thin_copies(watermarked, keys, delay, spread).dropDuplicatesWithinWatermark(keys)


def stream_pending_counts(snapshot_stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Blocks still pending, by page and tumbling window."""
    return (
        snapshot_stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "page_id")
        .agg(
            F.sum(F.regexp_count("html", F.lit(fixed.UNKNOWN_BLOCK_CLASS))).alias("n_unknown"),
            F.sum(F.regexp_count("html", F.lit(fixed.SHIMMER_CLASS))).alias("n_shimmer"),
            F.count("*").alias("n_snapshots"),
        )
        .select(F.col("w.start").alias("window_start"), "page_id", "n_unknown", "n_shimmer", "n_snapshots")
    )


class _Rounds:
    """Rounds of one page that have come but can't be decided on yet, because an earlier one may still come."""

    def __init__(self, numbers, times, *values):
        self.waiting = {n: (t, v) for n, t, *v in zip(numbers, times, *values)}

    def take_in(self, batches: Iterator[pd.DataFrame], columns: list[str], seen: int) -> None:
        """Add rounds after ``seen``; of copies the first one counts."""
        for batch in batches:
            fresh = batch[batch["attempt"] > seen].drop_duplicates("attempt")
            for n, t, *v in fresh[["attempt", "ms", *columns]].itertuples(index=False, name=None):
                self.waiting.setdefault(int(n), (int(t), v))

    def ready(self, seen: int, watermark: int) -> Iterator[tuple]:
        """Rounds in order: the next one, or one after a gap that the watermark has closed."""
        while self.waiting:
            n = min(self.waiting)
            if n != seen + 1 and self.waiting[n][0] >= watermark:
                return
            seen = n
            yield n, *self.waiting.pop(n)[1]

    def until(self) -> int:
        return min(t for t, _ in self.waiting.values()) + 1

    def columns(self, width: int) -> tuple:
        order = sorted(self.waiting)
        times = [self.waiting[n][0] for n in order]
        return order, times, *[[self.waiting[n][1][i] for n in order] for i in range(width)]


def _next_timeout(state: GroupState, rounds: _Rounds, done: bool, stall_ms: int) -> None:
    watermark = state.getCurrentWatermarkMs()
    waits = rounds.waiting and not done
    state.setTimeoutTimestamp(max(rounds.until(), watermark + 1) if waits else watermark + stall_ms)


def stream_stable_pages(
    snapshot_stream: DataFrame,
    k: int = fixed.HEIGHT_STABLE_ROUNDS,
    cap: int = fixed.HEIGHT_MAX_STEPS,
    delay: str = "1 hour",
    stall_ms: int = 3_600_000,
    initial: int = 0,
    spread: int = SPREAD,
) -> DataFrame:
    """``page_id, stop_attempt, is_stable``, the batch decision on whatever order of arrival within the watermark.

    A page is emitted when its height did not change for ``k`` rounds, when round ``cap - 1`` was
    seen, or when no snapshot came for ``stall_ms`` of event time. Rounds that come before an earlier one wait in the
    state, at most ``cap`` of them, until the gap is filled or the watermark has passed them. A page is emitted once
    until nothing of it has come for ``stall_ms``; snapshots with later times are a new visit of the page then.
    """

    def step(key, batches, state: GroupState):
        last, unchanged, attempt, done, *kept = state.get if state.exists else (initial, 0, -1, False, [], [], [])
        rounds, out, moved = _Rounds(*kept), [], False
        if not state.hasTimedOut and not done:
            rounds.take_in(batches, ["height"], attempt)
        for number, height in rounds.ready(attempt, state.getCurrentWatermarkMs()):
            attempt, moved = number, True
            if pd.notna(height):
                unchanged = unchanged + 1 if int(height) == last else 0
                last = int(height)
            if unchanged >= k or attempt >= cap - 1:
                out.append((key[0], attempt, unchanged >= k))
                done = True
                break
        if state.hasTimedOut and not moved:
            if not done:
                out.append((key[0], attempt, False))
            state.remove()
        else:
            numbers, times, heights = rounds.columns(1) if not done else ([], [], [])
            heights = [None if pd.isna(h) else int(h) for h in heights]
            state.update((last, unchanged, attempt, done, numbers, times, heights))
            _next_timeout(state, rounds, done, stall_ms)
        yield pd.DataFrame(out, columns=["page_id", "stop_attempt", "is_stable"])

    watermarked = snapshot_stream.where(F.col("attempt") < cap).withWatermark("ts", delay)
    return (
        _thin_copies(watermarked, ["page_id", "attempt"], delay, spread)
        .withColumn("ms", F.unix_millis("ts"))
        .groupBy("page_id")
        .applyInPandasWithState(
            step,
            "page_id long, stop_attempt long, is_stable boolean",
            "last long, unchanged long, attempt long, done boolean, numbers array<long>, times array<long>, heights array<long>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def stream_complete_pages(
    snapshot_stream: DataFrame,
    max_retries: int = fixed.MAX_RETRIES,
    delay: str = "1 hour",
    stall_ms: int = 3_600_000,
    spread: int = SPREAD,
) -> DataFrame:
    """``page_id, attempt, html, is_clean``, the batch decision on whatever order of arrival within the watermark.

    The first clean attempt ends a page; so does the last retry, or a stall, with ``is_clean`` false. Attempts that come
    before an earlier one wait as in :func:`stream_stable_pages`, and a page is emitted once as there.
    """

    def step(key, batches, state: GroupState):
        attempt, html, done, *kept = state.get if state.exists else (-1, "", False, [], [], [], [])
        rounds, out, moved = _Rounds(*kept), [], False
        if not state.hasTimedOut and not done:
            rounds.take_in(batches, ["clean", "html"], attempt)
        for number, clean, text in rounds.ready(attempt, state.getCurrentWatermarkMs()):
            attempt, html, moved = number, text, True
            if clean or attempt >= max_retries:
                out.append((key[0], attempt, html, bool(clean)))
                done = True
                break
        if state.hasTimedOut and not moved:
            if not done:
                out.append((key[0], attempt, html, False))
            state.remove()
        else:
            numbers, times, cleans, texts = rounds.columns(2) if not done else ([], [], [], [])
            state.update((attempt, "" if done else html, done, numbers, times, [bool(c) for c in cleans], texts))
            _next_timeout(state, rounds, done, stall_ms)
        yield pd.DataFrame(out, columns=["page_id", "attempt", "html", "is_clean"])

    watermarked = snapshot_stream.where(F.col("attempt") <= max_retries).withWatermark("ts", delay)
    return (
        _thin_copies(watermarked, ["page_id", "attempt"], delay, spread)
        .withColumn("ms", F.unix_millis("ts"))
        .groupBy("page_id")
        .applyInPandasWithState(
            step,
            "page_id long, attempt long, html string, is_clean boolean",
            "attempt long, html string, done boolean, numbers array<long>, times array<long>, cleans array<boolean>, texts array<string>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
