"""Compare registered queries with their SQL on DuckDB over one of the driver's data folders."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in rows)


def same(con, sql: str, df) -> None:
    found = con.execute(sql)
    assert _rows([d[0] for d in found.description], found.fetchall()) == _rows(df.columns, df.collect())
