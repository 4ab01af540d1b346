"""Comparing a query's rows with those of its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(x) + 0.0
    return x if isinstance(x, (bool, str)) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None if equal, else what differs."""
    spark_columns, spark_rows = df.columns, [tuple(r) for r in df.collect()]
    relation = con.sql(sql)
    duck_columns, duck_rows = relation.columns, relation.fetchall()
    if sorted(spark_columns) != sorted(duck_columns):
        return f"columns {sorted(spark_columns)} and {sorted(duck_columns)}"
    a, b = rows_of(spark_columns, spark_rows), rows_of(duck_columns, duck_rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows, such as {next((x for x in a + b if (x in a) != (x in b)), None) if len(a) + len(b) < 20000 else a[:2]}"
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(off)} of {len(a)} rows differ, such as {off[0]}" if off else None
