"""Run a query and its SQL over the same tables and compare them as multisets of rows."""

from __future__ import annotations

import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows_of(df) -> list[tuple]:
    return sorted((tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)


def sql_rows(c, sql: str) -> tuple[list[str], list[tuple]]:
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(g[i]) for i in order) for g in r.fetchall()), key=repr)
