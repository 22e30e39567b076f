"""Compares a Spark result with DuckDB SQL over the same tables."""

from pathlib import Path

import duckdb


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_value(r[c]) for c in columns) for r in frame.collect()), key=repr)


def _value(v):
    return round(v, 9) if isinstance(v, float) else v


def oracle_rows(sf_dir, sql):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(_value(r[i]) for i in at) for r in found.fetchall()), key=repr)
