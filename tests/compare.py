"""Side-by-side comparison of a registered query with its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


TYPE_NAMES = {
    "long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def spark_rows(df):
    names = sorted(df.columns)
    types = {f.name: TYPE_NAMES.get(f.dataType.typeName(), f.dataType.typeName()) for f in df.schema}
    rows = [tuple(_plain(v) for v in r) for r in df.select(*names).collect()]
    return names, [types[n] for n in names], _sorted(rows)


def sql_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    names = [rel.columns[i] for i in order]
    types = [str(rel.types[i]) for i in order]
    rows = [tuple(_plain(r[i]) for i in order) for r in rel.fetchall()]
    return names, types, _sorted(rows)


def differences(df, con, sql) -> str | None:
    names, types, rows = spark_rows(df)
    o_names, o_types, o_rows = sql_rows(con, sql)
    if names != o_names:
        return f"columns {names} != {o_names}"
    if types != o_types:
        return f"types {list(zip(names, types))} != {o_types}"
    if len(rows) != len(o_rows):
        return f"{len(rows)} rows != {len(o_rows)}"
    bad = [(a, b) for a, b in zip(rows, o_rows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ {names}: {bad[:3]}"
    return None if rows else "no rows"
