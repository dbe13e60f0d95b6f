"""Runs registered queries next to their SQL twins and compares every value."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    columns = []
    for c in df.columns:
        values = df[c].tolist()
        columns.append([None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v
                        for v in values])
    return sorted(zip(*columns), key=repr)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}"
    kinds = [(c, str(spark_df[c].dtype), str(sql_df[c].dtype)) for c in spark_df.columns
             if len(a) and spark_df[c].dtype != sql_df[c].dtype]
    return f"types {kinds}" if kinds else None


def run(spark, sf_dir: str, names=None):
    import __spark_entry__ as e

    queries, sqls = e.queries(), e.oracle_sql()
    con = connect(sf_dir)
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name in sqls:
                start = time.time()
                want = con.execute(sqls[name]).df()
                yield name, compare(got, want), len(got), took, time.time() - start
            else:
                yield name, None, len(got), took, None
        except Exception as error:  # report and go on with the next query
            yield name, f"{type(error).__name__}: {str(error)[:700]}", 0, time.time() - start, None
