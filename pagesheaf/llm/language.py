"""Language identification by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import drawn_rows, fold_of

# Bounds of the labelled sample: passages per language, characters of one passage.
PASSAGES = 150
PASSAGE_CHARS = 200
# Commonest letters of the references that have a code of their own; the tables have a column for each.
LETTERS = 250
# A parse starts anew every so many characters, so that one long text becomes many equal lanes.
BLOCK = 1024
# Characters of one round of lanes.
ROUND_CHARS = 4_000_000


def _has_letter(text: str) -> bool:
    """Letters are what the table of codes takes for letters; digits, fractions and numerals of any script are none."""
    return any(map(str.isalpha, text))


def _automaton(text: np.ndarray, letters: int) -> np.ndarray:
    """Dense transitions of the suffix automaton of a sequence of codes: table[state, code], 0 for none."""
    nexts: list[dict[int, int]] = [{}]
    links, lengths = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    table = np.zeros((len(nexts), letters), np.int32)
    for s, to in enumerate(nexts):
        if to:
            table[s, list(to)] = list(to.values())
    return table


def _parser(text: np.ndarray, letters: int) -> np.ndarray:
    """Transitions of the parse: a missing one restarts at the root. Low bit: a phrase begins with this character."""
    table = _automaton(text, letters)
    begins = table == 0
    begins[0] = True
    to = np.where(table == 0, table[0][None, :], table)
    return (to * letters * 2 + begins).astype(np.int32).ravel()


def _codes(text: str, code_of: np.ndarray) -> np.ndarray:
    """Lower-case letters as codes, every run of other characters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = code_of[points]
    blank = codes == 1
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return codes[keep]


@functools.lru_cache(maxsize=1)
def _model(references: tuple[tuple[str, str], ...]):
    """(code of each character, parsers, weights) once per worker process."""
    counts = Counter(c for _, t in references for c in t.lower() if c.isalpha())
    alphabet = sorted(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
    # 0: a letter of no reference, 1: anything that isn't a letter, from 2 on: the letters of the references.
    code_of = np.fromiter((0 if chr(i).isalpha() else 1 for i in range(0x110000)), np.uint8, 0x110000)
    for i, c in enumerate(alphabet):
        code_of[ord(c)] = i + 2
    parsers, weights = [], []
    for _, t in references:
        codes = _codes(t, code_of)
        parsers.append(_parser(codes, len(alphabet) + 2))
        weights.append(math.log2(len(codes) + 2))
    return code_of, parsers, np.array(weights)


def _phrases(blocks: list[np.ndarray], parser: np.ndarray) -> np.ndarray:
    """Phrases of each block; all blocks advance together, one character at a time. Longest blocks come first."""
    sizes = np.array([len(b) for b in blocks])
    lanes = np.zeros((int(sizes[0]), len(blocks)), np.uint8)
    for i, b in enumerate(blocks):
        lanes[: len(b), i] = b
    active = len(blocks) - np.searchsorted(sizes[::-1], np.arange(len(lanes)), "right")
    state, count = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int32)
    for row, n in zip(lanes, active.tolist()):
        v = parser.take(state[:n] + row[:n])
        count[:n] += v & 1
        state[:n] = v >> 1
    return count


def reference_texts(docs: DataFrame, folds: int = 5, held: int = 0) -> tuple[tuple[str, str], ...]:
    """(language, labelled text), at most ``PASSAGES`` x ``PASSAGE_CHARS`` characters of each language.

    Rows of the held-out fold, without a language or without a text give nothing. Each row gives at most one passage,
    from a place that a hash of the text names, and the rows are those with the smallest hashes.
    """
    seed = F.xxhash64("text")
    start = F.pmod(seed, F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = docs.where((fold_of("doc_id", folds) != held) & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", F.substring("text", start, F.lit(PASSAGE_CHARS)).alias("passage"), F.xxhash64("doc_id", "text").alias("h"))
    picked = drawn_rows(rows, "lang", "h", PASSAGES).collect()
    out: dict[str, list[tuple[int, str]]] = {}
    for r in picked:
        out.setdefault(r.lang, []).append((r.h, r.passage))
    return tuple((k, " ".join(p for _, p in sorted(out[k]))) for k in sorted(out))


def language_of(references: tuple[tuple[str, str], ...], text: Column) -> Column:
    """The language of a text as a column of (lang_pred, score).

    A text is parsed against each language into the longest matches with its labelled text; the language needing the
    fewest phrases, weighted by the logarithm of the length of its labelled text, wins, and the first in order on a tie.
    ``score`` is how much fewer they are than those of the second language, as a share (1 if one language was learned).
    Null texts, texts without a letter and tables without any labelled row give ``und`` and 0. Whole texts are parsed,
    in blocks of ``BLOCK`` characters.
    """
    names = np.array([k for k, _ in references], object)

    def phrases(blocks: list[np.ndarray], owners: list[int], parsers: list[np.ndarray], totals: np.ndarray) -> None:
        order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
        by_size, at = [blocks[i] for i in order], np.array(owners)[order]
        for k, parser in enumerate(parsers):
            np.add.at(totals[:, k], at, _phrases(by_size, parser))

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        code_of, parsers, weights = _model(references) if references else (None, [], np.zeros(0))
        for texts in parts:
            n = len(texts)
            totals = np.zeros((n, len(parsers)))
            some = np.zeros(n, bool)
            owners, blocks, held = [], [], 0
            for i, x in enumerate(texts):
                if not parsers or not x or not _has_letter(x):
                    continue
                some[i] = True
                codes = _codes(x, code_of)
                for j in range(0, len(codes), BLOCK):
                    blocks.append(codes[j:j + BLOCK])
                    owners.append(i)
                held += len(codes)
                if held > ROUND_CHARS:
                    phrases(blocks, owners, parsers, totals)
                    owners, blocks, held = [], [], 0
            if blocks:
                phrases(blocks, owners, parsers, totals)
            pred, score = np.full(n, "und", object), np.zeros(n)
            if parsers and n:
                costs = totals * weights
                best = np.argmin(costs, axis=1)
                low = costs[np.arange(n), best]
                costs[np.arange(n), best] = np.inf
                second = costs.min(axis=1)
                share = np.ones(n) if len(parsers) == 1 else 1 - low / np.where(second > 0, second, 1)
                pred[some] = names[best[some]]
                score[some] = np.clip(share[some], 0, 1)
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    return predict(text)


def identify_language(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``.

    Learns from the labelled rows outside the held-out fold; language, source and id are no inputs of a prediction.
    Repeated rows stay repeated, null ids are kept (they are in fold 0), other columns are not read.
    """
    found = language_of(reference_texts(docs, folds, held), F.col("text"))
    scored = docs.select("doc_id", (fold_of("doc_id", folds) == held).alias("held_out"), found.alias("found"))
    return scored.select("doc_id", "held_out", "found.lang_pred", "found.score")
