"""Compare a query with its SQL in DuckDB: column names, types, rows."""

from __future__ import annotations

import collections
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        if os.path.isdir(path):
            path += "/*.parquet"
        elif not os.path.exists(path):
            continue
        con.execute(f"create view {table} as select * from '{path}'")
    return con


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return a == b


def differences(df, con, sql: str) -> list[str]:
    """Empty when the query and the SQL agree."""
    names = sorted(df.columns)
    got = [tuple(row) for row in df.select(*names).collect()]
    con.execute(sql)
    header = {d[0]: str(d[1]) for d in con.description}
    raw = con.fetchall()
    order = [list(header).index(n) for n in sorted(header)]
    want = [tuple(row[i] for i in order) for row in raw]
    problems = []
    if names != sorted(header):
        return [f"columns {names} != {sorted(header)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind) != header[name]:
            problems.append(f"{name}: {kind} against {header[name]}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows, expected {len(want)}")

    def key(row):
        return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)

    got, want = sorted(got, key=key), sorted(want, key=key)
    exact = collections.Counter(got) == collections.Counter(want)
    if not exact:
        off = [
            (g, w)
            for g, w in zip(got, want)
            if not all(_same(a, b) for a, b in zip(g, w))
        ]
        problems.append(f"values differ (beyond 1e-12: {len(off)}), e.g. {off[:2]}")
    return problems
