"""Compare a query with its SQL on the same tables, as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return tuple(map(plain, x)) if isinstance(x, list) else x


def bags(df, con, sql: str):
    names = sorted(df.columns)
    cur = con.execute(sql)
    got = [c[0] for c in cur.description]
    assert sorted(got) == names, (sorted(got), names)
    order = [got.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    have = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    kinds = {c[0]: str(c[1]) for c in cur.description}
    return have, want, kinds
