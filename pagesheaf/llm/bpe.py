"""BPE encoding and decoding with a pair occurrence index.

A task lays the pre-tokens it has not met before behind each other in one array of symbols and maps every pair that has a
rank to all its positions there. The active ranks are applied in ascending order: the smallest one is taken from the heap,
every position of its pair is merged from left to right, and the pairs that a merge makes with its two neighbours are added
to the lists of their ranks. A position whose pair has gone meanwhile is skipped. That is what merging each pre-token
alone gives if a merge never makes a pair of a smaller rank, which holds where every symbol is made by one merge and after
its parts; other vocabularies are refused.

Texts never leave their task and nothing is exchanged. A pre-token that stands often stands in the array once, and a
worker process remembers the ids of the pre-tokens it has met, up to ``REMEMBERED`` characters of them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.token_counts import vocabulary_path

# Characters of pre-tokens a worker process remembers, and characters of texts that are encoded together.
REMEMBERED = 16_000_000
ROUND_CHARS = 2_000_000


class Model(NamedTuple):
    """What a vocabulary file says: first symbols, merges by pair (left * width + right), parts by rank, strings by id."""

    first: dict[str, int]
    last: dict[str, int]
    ranks: dict[int, int]
    parts: list[tuple[int, int, int]]
    width: int
    strings: list[str]
    special: dict[str, int]
    pretokens: Callable[[str], list[str]]


@functools.lru_cache(maxsize=2)
def _model(name: str) -> Model:
    """The vocabulary of a file, once per worker process."""
    with open(vocabulary_path(name), encoding="utf-8") as file:
        spec = json.load(file)
    bpe = spec["model"]
    odd = [a for a in spec["added_tokens"] if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]]
    other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if bpe.get(k)]
    if bpe["type"] != "BPE" or spec.get("decoder") or odd or other:
        raise ValueError(f"{name}: not a plain BPE vocabulary without a decoder")
    vocab, end = bpe["vocab"], bpe.get("end_of_word_suffix") or ""
    characters = _byte_characters().values()
    alphabet = {c + e for c in characters for e in ("", end)}
    width = max(vocab.values()) + 1
    ranks, parts, made = {}, [], set()
    for rank, merge in enumerate(bpe["merges"]):
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        if a + b in made or any(p not in made and p not in alphabet for p in (a, b)):
            raise ValueError(f"{name}: the symbol {a + b} is made twice or before its parts")
        made.add(a + b)
        ranks[vocab[a] * width + vocab[b]] = rank
        parts.append((vocab[a], vocab[b], vocab[a + b]))
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    strings = [""] * max(width, *(i + 1 for i in special.values()), 1)
    for s, i in (vocab | special).items():
        strings[i] = s
    first, last = {c: vocab[c] for c in characters}, {c: vocab[c + end] for c in characters}
    return Model(first, last, ranks, parts, width, strings, special, _pretokens(name, spec))


@functools.lru_cache(maxsize=1)
def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a character: printable ones of Latin-1 as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@functools.lru_cache(maxsize=100_000)
def _recent(character: str) -> bool:
    """True for characters newer than Unicode 3.2, about which the library's tables and Python's may disagree."""
    return unicodedata.ucd_3_2_0.category(character) == "Cn"


def _pretokens(name: str, spec: dict) -> Callable[[str], list[str]]:
    """A function from a text without special strings to its pre-tokens.

    Lower-casing vocabularies that keep the matches of one pattern are cut here; whatever else a file asks for, and texts
    with recent characters, the library normalises and cuts itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path(name))
    normal, cut = library.normalizer, library.pre_tokenizer

    to_bytes = str.maketrans({c: chr(b) for b, c in _byte_characters().items()})

    def by_library(text: str) -> list[str]:
        text = normal.normalize_str(text) if normal else text
        return [w.translate(to_bytes).encode("latin-1").decode("utf-8") for w, _ in cut.pre_tokenize_str(text)]

    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    known = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [s["type"] for s in split] == ["Split", "ByteLevel"]
        and split[0]["behavior"] == "Removed" and split[0]["invert"] and "Regex" in split[0]["pattern"]
        and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        # White space then stands in no match, so that runs of it need not be shortened first.
        and not re.search(r"\s", split[0]["pattern"]["Regex"])
    )
    if not known:
        return by_library
    pattern = split[0]["pattern"]["Regex"]
    words = regex.compile(pattern).findall
    # The same for ASCII texts, in which the classes of the pattern are short lists.
    plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t-\r")
    ascii_words = words if r"\p" in plain else re.compile(plain).findall
    beyond = re.compile("[^\\x00-\u024f]").findall

    def of(text: str) -> list[str]:
        if text.isascii():
            return ascii_words(text.lower())
        if any(map(_recent, set(beyond(text)))):
            return by_library(text)
        # The library lower-cases character by character, so a sigma at the end of a word is no special case.
        return words(unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower())

    return of


def merged(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words behind each other, number of ids of each) by a pair occurrence index over all of them.

    The words are written in byte characters.
    """
    first, last, ranks, parts, width = model.first, model.last, model.ranks, model.parts, model.width
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    symbols = list(map(first.__getitem__, "".join(words)))
    after, before = list(range(1, total + 1)), list(range(-1, total - 1))
    for w, end in zip(words, ends.tolist()):
        if w:
            symbols[end - 1] = last[w[-1]]
            after[end - 1] = before[end - len(w)] = -1
    places: dict[int, list[int]] = {}
    rank_of = ranks.get
    for i, (a, b, j) in enumerate(zip(symbols, symbols[1:], after)):
        if j >= 0:
            rank = rank_of(a * width + b)
            if rank is not None:
                if rank in places:
                    places[rank].append(i)
                else:
                    places[rank] = [i]
    active = list(places)
    heapify(active)
    while active:
        rank = heappop(active)
        left, right, made = parts[rank]
        # From left to right, as of overlapping pairs of one symbol the first is merged.
        for i in sorted(places.pop(rank)):
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = made, -1
            h, k = before[i], after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                new = rank_of(made * width + symbols[k])
                if new is not None:
                    if new in places:
                        places[new].append(i)
                    else:
                        places[new] = [i]
                        heappush(active, new)
            if h >= 0:
                new = rank_of(symbols[h] * width + made)
                if new is not None:
                    if new in places:
                        places[new].append(h)
                    else:
                        places[new] = [h]
                        heappush(active, new)
    ids = np.array(symbols, np.int64)
    kept = ids >= 0
    counts = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))]
    return ids[kept].astype(np.int32), np.diff(counts)


class _Lexicon(dict):
    """Numbers of the pre-tokens met so far, and the ids of all of them behind each other.

    A pre-token that is looked up for the first time gets the next number and waits in ``new``. Special strings are kept
    apart from pre-tokens of the same characters by their type, a tuple.
    """

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def __missing__(self, word) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def forget(self) -> None:
        self.clear()
        self.new: list = []
        self.ids, self.sizes, self.characters = np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def learn(self, model: Model) -> None:
        to_characters = {b: c for b, c in _byte_characters().items() if chr(b) != c}
        words = ["" if isinstance(w, tuple) else w if w.isascii() and w.isprintable()
                 else w.encode("utf-8").decode("latin-1").translate(to_characters) for w in self.new]
        ids, sizes = merged(words, model)
        for i in [i for i, w in enumerate(self.new) if isinstance(w, tuple)]:
            ids = np.insert(ids, sizes[:i].sum(), model.special[self.new[i][0]])
            sizes[i] = 1
        self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
        self.characters += sum(map(len, words))
        self.new = []


@functools.lru_cache(maxsize=2)
def _lexicon(name: str) -> _Lexicon:
    """One for each vocabulary and worker process."""
    return _Lexicon()


def _encode(texts: list[str], name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts behind each other, number of ids of each)."""
    model, lexicon = _model(name), _lexicon(name)
    special = sorted(model.special, key=len, reverse=True)
    marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    if lexicon.characters > REMEMBERED:
        lexicon.forget()
    number, numbers = lexicon.__getitem__, [np.zeros(0, np.int64)]
    for t in texts:
        words: list = []
        if any(s in t for s in special):
            for i, part in enumerate(marks.split(t)):
                words += [(part,)] if i % 2 else model.pretokens(part)
        else:
            words = model.pretokens(t)
        numbers.append(np.fromiter(map(number, words), np.int64, len(words)))
    lexicon.learn(model)
    spots = np.concatenate(numbers)
    starts = np.concatenate(([0], np.cumsum(lexicon.sizes)))
    sizes = lexicon.sizes[spots]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    ids = lexicon.ids[np.arange(total) + np.repeat(starts[spots] - ends + sizes, sizes)]
    cuts = np.concatenate(([0], ends))[np.cumsum([len(n) for n in numbers])]
    return ids, np.diff(cuts)


def _rounds(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, ids behind each other, number of ids of each) of batches of (key, text), some texts at a time."""
    for b in batches:
        i = 0
        while i < b.num_rows:
            texts, held, j = [], 0, i
            while j < b.num_rows and held < ROUND_CHARS:
                texts.append(b.column(1)[j].as_py() or "")
                held, j = held + len(texts[-1]), j + 1
            yield b.column(0)[i:j], *_encode(texts, name)
            i = j


def _joined(strings: list[str], ids: np.ndarray, counts: np.ndarray) -> Iterator[str]:
    """The strings of each list of ids, joined by blanks."""
    string, end = strings.__getitem__, 0
    for n in counts.tolist():
        yield " ".join(map(string, ids[end:end + n].tolist()))
        end += n


def encode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, ids), one per row of ``docs``: the ids of the whole text as the library for the file gives them.

    No special tokens are added; special strings inside a text become their ids, as is the library's default. Null and
    empty texts give an empty list. Repeated rows stay repeated, a null key is kept, an empty table gives no rows, other
    columns are not read. A batch's texts are encoded in rounds of about ``ROUND_CHARS`` characters, so a task holds the
    ids of one round, or of one text that is longer.
    """
    schema = docs.select(F.col(key), F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, counts in _rounds(batches, vocabulary):
            cuts = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(cuts, pa.array(ids))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str = "word_bpe_49k.json", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``encoded`` with the texts of their ids in column ``text``; special tokens are kept.

    A file without a decoder, the only kind taken here, joins the vocabulary's strings with blanks. A null list gives
    null, an empty one the empty text; a null or unknown id raises. All columns of ``encoded`` are kept; one that is
    named like ``text`` is replaced.
    """
    others = [c for c in encoded.columns if c != text]
    rows = encoded.select(*others)
    schema = rows.withColumn(text, F.lit(None).cast("string")).schema
    place = others.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _model(vocabulary).strings
        for b in batches:
            column = b.column(place)
            for i in range(0, b.num_rows, 256):
                part = column[i:i + 256]
                texts = [None if x.as_py() is None else next(_joined(strings, x.values.to_numpy(), np.array([len(x)]))) for x in part]
                yield pa.RecordBatch.from_arrays([*b.slice(i, 256).columns, pa.array(texts, pa.string())], [*others, text])

    return rows.mapInArrow(run, schema)


def encoding_digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256): texts encoded as by ``encode`` and decoded again as by ``decode``.

    Only the digests leave the task: SHA-256 of the decimal ids joined by one space, and of the decoded text. Null texts
    count as empty; repeated rows, null keys, empty tables and other columns are treated as by ``encode``.
    """
    texts = [F.lit("").alias(c) for c in ("ids_sha256", "decoded_sha256")]
    schema = docs.select(key, F.lit(0).cast("bigint").alias("n_tokens"), *texts).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _model(vocabulary).strings
        decimal = list(map(str, range(len(strings))))
        for keys, ids, counts in _rounds(batches, vocabulary):
            digests = [pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in _joined(table, ids, counts)], pa.string())
                       for table in (decimal, strings)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), *digests], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)
