"""Licence scans: an exact set-similarity join of text blocks with licence templates, in DataFrame functions only.

A block is a window of ``BLOCK`` words that starts at every ``STEP``-th word, so a notice of up to ``STEP`` words lies
whole in at least one block. A template is found in a block that holds at least a given share of its distinct words.
Words are ordered by their frequency in the whole corpus, the rarest first. A block that holds ``need`` of the ``size``
words of a template holds one of its first ``size - need + 1`` words, so only blocks with such a word are looked at; of
these, only blocks that are long enough, and whose remaining words after the first common one are enough, are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesheaf.llm.common import stored

BLOCK, STEP = 64, 32
THRESHOLD = 0.9

# Phrases that must stand consecutively, and their labels.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

# Words of public licence notices, at most STEP words each, and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a whole text with A to Z in lower case; null gives none.

    ``lower`` is several times faster than ``translate`` and differs only in letters beyond ASCII. Those are parts of
    words either way; only the two of them that turn into ASCII letters need ``translate``.
    """
    whole = F.coalesce(text, F.lit(""))
    odd = whole.contains("İ") | whole.contains("K")
    small = F.when(odd, F.translate(whole, _UPPER, _LOWER)).otherwise(F.lower(whole))
    return F.array_remove(F.split(small, _GAP, -1), "")


def base_columns(words: Column, phrases=BASE_PHRASES) -> list[Column]:
    """n_base, first_word, last_word and base_labels of an array of words."""
    # A phrase can't stand without its longest word; rows with none of these need no closer look.
    rare = F.array(*[F.lit(w) for w in sorted({max(p.split(), key=len) for p, _ in phrases})])
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    anyone = "|".join(p for p, _ in phrases)
    parts = F.when(F.arrays_overlap(words, rare), F.split(spaced, f" (?=(?:{anyone}) )", -1))
    spaces = lambda part: F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))
    n = F.when(parts.isNull(), F.lit(0)).otherwise(F.size(parts) - 1).cast("bigint")
    first = F.when(n > 0, spaces(parts[0]).cast("bigint"))
    last = F.when(n > 0, (F.size(words) - spaces(F.element_at(parts, -1))).cast("bigint"))
    marks = F.array(*[F.when(spaced.contains(f" {p} "), F.lit(label)) for p, label in phrases])
    labels = F.when(n > 0, F.array_sort(F.array_distinct(F.array_compact(marks)))).otherwise(F.array().cast("array<string>"))
    return [n.alias("n_base"), first.alias("first_word"), last.alias("last_word"), labels.alias("base")]


def _frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Occurrences in the whole corpus of each word of the templates; as many rows as the templates have words."""
    spark = words.sparkSession
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    counts = words.select(F.explode("words").alias("word")).join(known, "word").groupBy("word").count().collect()
    return {w: 0 for w in vocabulary} | {r.word: r["count"] for r in counts}


def license_scan(
    docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES, phrases=BASE_PHRASES,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Rows (key, n_words, n_base, first_word, last_word, base_labels, labels, score), one per row of ``docs``.

    ``base_labels`` and ``n_base`` tell of the phrases that stand word by word, ``labels`` also of every template of
    which some block holds at least ``threshold`` of the distinct words. ``score`` is the largest such share, 1 if a
    phrase was found, else 0. Label lists are empty strings if nothing was found. Null texts count as empty, a null key is
    kept, repeated rows stay repeated, an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split()))) for label, t in templates]
    if any(len(t.split()) > STEP for _, t in templates):
        raise ValueError(f"a template has more than {STEP} words")
    tokens = docs.select(F.col(key), F.xxhash64(text).alias("_h"), words_of(F.col(text)).alias("words"))
    counts = _frequencies(tokens, sorted({w for _, s in sets for w in s}))
    rank = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    index, firsts = [], set()
    for i, (label, s) in enumerate(sets):
        ranks, need = sorted(rank[w] for w in s), math.ceil(threshold * len(s) - 1e-9)
        for p, r in enumerate(ranks[: len(s) - need + 1], 1):
            index.append((r, i, label, p, need, ranks))
            firsts.add(r)
    prefix_words = [w for w, r in rank.items() if r in firsts]
    hit = F.arrays_overlap("words", F.array(*[F.lit(w) for w in prefix_words]))
    rows = tokens.select(
        key, "_h", F.size("words").cast("bigint").alias("n_words"), *base_columns(F.col("words"), phrases),
        F.when(hit, F.col("words")).alias("words"),
    )
    rows = stored(rows, "licence-rows")

    # All of these small tables are as large as the templates, whatever the corpus.
    known = F.broadcast(spark.createDataFrame(list(rank.items()), "word string, rank int"))
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, p int, need int, ranks array<int>"))
    found = rows.where("words is not null").select(key, "_h", F.posexplode("words").alias("pos", "word")).join(known, "word")
    last = F.floor(F.col("pos") / STEP).cast("int")
    blocks = found.select(key, "_h", "rank", F.explode(F.array(last, last - 1)).alias("block")).where("block >= 0")
    blocks = blocks.groupBy(key, "_h", "block").agg(F.sort_array(F.collect_set("rank")).alias("held"))
    probes = blocks.select(key, "_h", "block", "held", F.posexplode("held").alias("q", "rank")).join(prefixes, "rank")
    enough = F.least(F.size("ranks") - F.col("p"), F.size("held") - F.col("q") - 1) + 1 >= F.col("need")
    near = probes.where((F.size("held") >= F.col("need")) & enough)
    common = F.size(F.array_intersect("held", "ranks"))
    near = near.withColumn("common", common).where("common >= need")
    labels = near.groupBy(key, "_h").agg(
        F.collect_set("label").alias("more"), F.max(F.col("common") / F.size("ranks")).alias("share"))
    labels = labels.withColumnsRenamed({key: "_key", "_h": "_hash"})
    out = rows.drop("words").join(labels, rows[key].eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
