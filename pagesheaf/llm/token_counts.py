"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

The join is made inside the tasks. Joining in Spark moves every (document, pre-token) pair that is not a vocabulary entry,
about 40 million for 0.5 GB of documents, which is more than the documents themselves; the README has the figures. So each
worker process keeps a lexicon of the pre-tokens it has met with their numbers of pieces, and no text or pair is moved.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pre-tokens that a worker process remembers, and characters of texts that are counted together.
REMEMBERED = 1_000_000
ROUND_CHARS = 4_000_000

def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file on this machine; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _library(name: str):
    """(tokenizer, special strings) of a byte-level BPE file, once per worker process."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    odd = [a for a in spec["added_tokens"] if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]]
    if spec.get("normalizer") or not plain or odd or spec["model"]["type"] != "BPE":
        raise ValueError(f"{name} is not a plain byte-level BPE vocabulary")
    return Tokenizer.from_file(path), [a["content"] for a in spec["added_tokens"]]


@functools.lru_cache(maxsize=1)
def _alphabet() -> dict[int, str]:
    """Byte-level BPE writes a byte as a character: printable ones of Latin-1 as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def _lexicon(name: str) -> dict[str, int]:
    """Pre-tokens met so far with their numbers of pieces; one for each vocabulary and worker process."""
    return {}


def _learn(name: str, lexicon: dict[str, int], pretokens: set[str]) -> None:
    """Count the pieces of new pre-tokens. Each is one word of the model, so it is not split again."""
    tokenize, alphabet = _library(name)[0].model.tokenize, _alphabet()
    for p in pretokens:
        lexicon[p] = len(tokenize(p.encode("utf-8").decode("latin-1").translate(alphabet)))


_BEYOND = re.compile("[^\\x00-\u024f]").findall


def _unassigned(text: str) -> bool:
    """True if this Python's character tables don't know some character of the text.

    On newer characters the pattern and the library may disagree about what a letter is, so the library cuts such texts
    itself. All characters up to the end of the Latin blocks are assigned.
    """
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(_BEYOND(text)))


def _pretokens(name: str):
    """A function from text to (pre-tokens, number of special strings)."""
    import regex
    from public_tokenizers import PATTERN

    tokenizer, special = _library(name)
    words, cut, new = regex.compile(PATTERN).findall, tokenizer.pre_tokenizer.pre_tokenize_str, _unassigned
    marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def of(text: str) -> tuple[list[str], int]:
        parts = marks.split(text) if marks and any(s in text for s in special) else [text]
        out: list[str] = []
        for p in parts:
            out += [p[a:b] for _, (a, b) in cut(p)] if new(p) else words(p)
        return out, len(parts) - 1

    return of


def token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit), one per row of ``docs``.

    ``n_tokens`` is what the library gives for the whole text without added special tokens; special strings inside a
    text count as one token, as is its default. Null texts count as empty (0, 0). Repeated rows stay repeated, a null id
    is kept, an empty table gives no rows, other columns are not read. No token ids leave the library.
    """
    names = [key, "n_tokens"]
    schema = docs.select(F.col(key), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("n_bytes")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, lexicon = _pretokens(vocabulary), _lexicon(vocabulary)
        for b in batches:
            totals: list[int] = []
            frequencies: list[tuple[Counter, int]] = []
            held = 0

            def join() -> None:
                new = set(filterfalse(lexicon.__contains__, chain.from_iterable(f for f, _ in frequencies)))
                if len(lexicon) + len(new) > REMEMBERED:
                    lexicon.clear()
                    new = set().union(*(f.keys() for f, _ in frequencies))
                _learn(vocabulary, lexicon, new)
                totals.extend(special + sum(map(mul, map(lexicon.__getitem__, f), f.values())) for f, special in frequencies)

            for x in b.column(1):
                text_ = x.as_py() or ""
                pretokens, special = cut(text_)
                frequencies.append((Counter(pretokens), special))
                held += len(text_)
                if held > ROUND_CHARS:
                    join()
                    frequencies, held = [], 0
            join()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(totals, pa.int64()), b.column(2)], [*names, "n_bytes"])

    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint")
    counted = docs.select(key, text, size.alias("n_bytes")).mapInArrow(run, schema)
    return counted.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
