"""Mixing sources to target weights by temperature, in DataFrame functions only.

The share of a source in all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and
normalised. The exponent is bisected to the smallest that repeats no source too often, or to a target entropy. A source
then has a number of passes, the last one usually in part. Every pass goes through the source in an order of its own,
given by a hash, and is laid evenly over blocks of a fixed budget of tokens, so that every block has the target weights;
inside a block the rows are permuted again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored

# Tokens of one block, and the slices of the hash range over which a pass is summed.
BLOCK_TOKENS = 1_000_000
SLICES = 4096
# Exponents looked at in one job (so many steps of the bisection at once), and jobs.
SECTIONS, ROUNDS = 32, 6


def word_count(text: Column) -> Column:
    """Words of a text as its number of tokens; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "text")


def _pass_hash(row_hash: Column | str, number: Column | str, seed: int) -> Column:
    return F.xxhash64(row_hash, number, F.lit(seed))


def source_tokens(units: DataFrame) -> DataFrame:
    return units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def _measures(sources: DataFrame, total: int, budget: int | None, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """(entropy of the weights, most passes of any source) for each exponent."""
    log = F.log(F.col("tokens") / total)
    rows = sources.where("tokens > 0").select(log.alias("l"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.exp(F.col("a") * F.col("l"))
    lift = (F.col("a") - 1) * F.col("l")
    sums = rows.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("l")).alias("s"), F.max(lift).alias("hi"), F.min(lift).alias("lo"))
    out = {}
    for r in sums.collect():
        entropy = math.log(r.z) - r.a * r.s / r.z
        most = math.exp(r.hi - r.lo) if budget is None else budget / total * math.exp(r.hi) / r.z
        out[r.a] = (entropy, most)
    return out


def find_exponent(
    sources: DataFrame, total: int, max_passes: float | None, entropy: float | None, budget: int | None
) -> float:
    """The exponent that meets the limit of passes and the entropy, from the table of sources; 1 if none below does.

    Entropy falls and the most passes fall as the exponent rises. The limit of passes goes before the entropy.
    """
    low, high = 0.0, 1.0

    def too_flat(measured: tuple[float, float]) -> bool:
        limited = max_passes is not None and measured[1] > max_passes * (1 + 1e-12)
        return limited or (entropy is not None and measured[0] > entropy)

    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        measured = _measures(sources, total, budget, grid)
        flat = [a for a in grid if a in measured and too_flat(measured[a])]
        if not flat:
            return low
        low = max(flat)
        high = min([a for a in grid if a > low], default=high)
    return high


def mixing_plan(
    docs: DataFrame, max_passes: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
    tokens: Column | None = None, seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """(units, sources) for ``docs`` with columns doc_id, text and source.

    ``units``: doc_id, row hash, source, n_tokens of every row. ``sources``: source, tokens, n_docs, weight, passes,
    full (whole passes) and cut (the largest hash of the last, partial pass; null if there is none). Without a budget
    the source that is repeated least gets exactly one pass, so no row is left out. A partial pass ends with the row
    that reaches its share. A source without tokens gets one pass and the weight 0.
    """
    count = word_count(F.col("text")) if tokens is None else tokens
    units = stored(docs.select("doc_id", _row_hash().alias("h"), "source", count.alias("n_tokens")), "mixing-units")
    sources = stored(source_tokens(units), "mixing-sources")
    total = int(sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    if not total:
        flat = sources.select(
            "*", F.lit(0.0).alias("weight"), F.lit(1.0).alias("passes"), F.lit(1).alias("full"), F.lit(None).cast("bigint").alias("cut"))
        return units, flat
    exponent = find_exponent(sources, total, max_passes, entropy, budget)
    share = F.col("tokens") / total
    power = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent))).otherwise(F.lit(0.0))
    least = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent - 1)))
    z, lowest = sources.agg(F.sum(power), F.min(least)).first()
    scale = 1 / lowest if budget is None else budget / total / z
    passes = F.when(F.col("tokens") > 0, F.round(least * scale, 9)).otherwise(F.lit(1.0))
    named = sources.select("*", (power / z).alias("weight"), passes.alias("passes")).withColumn("full", F.floor("passes").cast("int"))
    named = stored(named, "mixing-passes")

    partial = named.where("passes > full").select("source", "full", ((F.col("passes") - F.col("full")) * F.col("tokens")).alias("wanted"))
    partial = partial.withColumnRenamed("source", "_source")
    last = units.join(partial, F.col("source").eqNullSafe(F.col("_source"))).withColumn("u", _pass_hash("h", "full", seed))
    reached = _running(last, ["source"]).where("before < wanted")
    cuts = reached.groupBy("source").agg(F.max("u").alias("cut")).withColumnRenamed("source", "_source")
    sources = named.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return units, stored(sources, "mixing-cuts")


def _running(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``before``: tokens of the rows of the group that come first in the order of ``u``.

    The range of the hash is cut into slices that are summed first. So a source that holds most rows is spread over
    many tasks, and only its slices, of a fixed number, meet in one.
    """
    sliced = rows.withColumn("slice", F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * SLICES).cast("int"))
    sums = sliced.groupBy(*group, "slice").agg(F.sum("n_tokens").alias("t"))
    ahead = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("t").over(ahead), F.lit(0))).drop("t")
    starts = starts.withColumnsRenamed({c: f"of_{c}" for c in [*group, "slice"]})
    same = F.col("slice") == F.col("of_slice")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    inside = Window.partitionBy(*group, "slice").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return sliced.withColumn("own", own).join(starts, same).withColumn("before", F.col("start") + F.col("own")).drop(
        "own", "start", "slice", "of_slice", *[f"of_{c}" for c in group])


def _taken(h: str, seed: int) -> Column:
    """Passes that a row takes part in: the whole ones, and the last if its hash is within the cut."""
    within = F.coalesce(_pass_hash(h, "full", seed) <= F.col("cut"), F.lit(False))
    return F.col("full") + within.cast("int")


def mixed_order(
    docs: DataFrame, max_passes: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS, tokens: Column | None = None, seed: int = 11,
) -> DataFrame:
    """Rows (doc_id, source, n_tokens, weight, pass, block, place): the mixture in reading order of (block, place).

    A row of ``docs`` comes once for each pass. Null sources are a source of their own, null texts have no tokens, rows
    that are repeated in ``docs`` are so many rows here, an empty table gives no rows, other columns are not read.
    """
    units, sources = mixing_plan(docs, max_passes, entropy, budget, tokens, seed)
    size = sources.agg(F.sum(F.col("passes") * F.col("tokens"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_tokens))
    named = sources.withColumnRenamed("source", "_source")
    rows = units.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("taken", _taken("h", seed)).where("taken > 0")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("taken") - 1)))
    rows = rows.withColumn("u", _pass_hash("h", "pass", seed))
    rows = _running(rows, ["source", "pass"])
    at = (F.col("pass") * F.col("tokens") + F.col("before")) / (F.col("passes") * F.col("tokens"))
    # Rows of a source without tokens are spread by their hash.
    at = F.when(F.col("tokens") > 0, at).otherwise(F.col("u") / F.lit(2.0**64) + 0.5)
    block = F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("bigint")
    rows = rows.withColumn("block", block).withColumn("v", F.xxhash64("u", F.lit(seed)))
    place = F.row_number().over(Window.partitionBy("block").orderBy("v", "doc_id", "pass"))
    return rows.select("doc_id", "source", "n_tokens", "weight", "pass", "block", place.alias("place"))


def mixed_documents(
    docs: DataFrame, max_passes: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
    tokens: Column | None = None, seed: int = 11,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture has it. Texts stay where they are: whether a row is in the
    last pass of its source follows from its own hash."""
    sources = mixing_plan(docs, max_passes, entropy, budget, tokens, seed)[1]
    named = sources.select(F.col("source").alias("_source"), "full", "cut")
    # The row travels as one column, so that no name of its own can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), _row_hash().alias("h"))
    rows = rows.join(named, F.col("of").eqNullSafe(F.col("_source"))).withColumn("taken", _taken("h", seed))
    rows = rows.where("taken > 0").select("row", F.explode(F.sequence(F.lit(1), "taken")).alias("pass"))
    return rows.select("row.*")
