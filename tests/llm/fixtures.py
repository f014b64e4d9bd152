"""Small tables with the cases that every operator has to bear."""

from __future__ import annotations

WORDS = "the of and river stone quick paper window yellow garden market letter bridge winter summer doctor simple".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("" if x % 7 else str(x % 97)))
    return " ".join(out)


def documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, prose(i, 30 + i), "en", f"s{i % 3}") for i in range(1, 40)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \n\t ", None, "s1"), (None, prose(3, 40), "en", None)]
    rows += [(103, prose(9, 60_000), "en", "s0"), (104, prose(5, 35), "en", "s2"), (104, prose(5, 35), "en", "s2")]
    rows += [(105, "Ünïcode ünd Émile ça <|endoftext|> 中文 \U00010940 ﷽", "fr", "s1"), (120, "x", None, "s1"), (140, "%%% 12", "en", "s1")]
    rows = [(*r, "a", 1.0, 7, "b", 5, "c") for r in rows]
    names = "doc_id bigint, text string, lang string, source string, score string, n_chars double, copies int, _h string, full int, row string"
    return spark.createDataFrame(rows, names)


def empty(spark):
    return documents(spark).limit(0)


def pairs(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
