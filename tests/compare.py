"""Compare registered queries with their SQL: row count, columns and an order-free value check."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = _rows([d[0] for d in res.description], res.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if got == want:
        return None
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return f"rows {len(got)} / {len(want)}\n  only spark {sorted(only_got)[:2]}\n  only sql   {sorted(only_want)[:2]}"
