"""Comparison of registered queries with their SQL twins on the smallest test tables."""

from __future__ import annotations

import os
from collections import Counter

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings book page chunk shot eval_items".split()


def connect():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(spark, queries, sql) -> list[str]:
    """Names of queries whose rows differ from their twin's."""
    c, out = connect(), []
    for name, q in sql.items():
        df = queries[name](spark, SF)
        cols = sorted(df.columns)
        r = c.execute(q)
        at = {x[0]: i for i, x in enumerate(r.description)}
        if sorted(at) != cols:
            out.append(f"{name}: columns")
            continue
        want = Counter(tuple(plain(row[at[k]]) for k in cols) for row in r.fetchall())
        got = Counter(tuple(plain(row[k]) for k in cols) for row in df.collect())
        if want != got:
            out.append(name)
    return out


def missing() -> bool:
    return not os.path.exists(SF)
