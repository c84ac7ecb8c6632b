"""Compare Spark results with the SQL oracle run by DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, type(v).__name__, str(v)) for v in row)


def _value(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=_key)


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in cur.fetchall()), key=_key)
