"""Run registered queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return value + 0.0
    return str(value)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides have the same columns and rows."""
    a = table_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    b = table_rows([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} != {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} != {len(b[1])}"
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(wrong)} of {len(a[1])} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from segflow.plans import all_queries
    from segflow.session import local_session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = all_queries()
    bad = 0
    for name, run in queries.items():
        if names and not any(n in name for n in names):
            continue
        began = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                result = difference(df, con, oracles[name])
                note = "same" if result is None else f"DIFFERENT {result[:600]}"
            else:
                result, note = None, f"rows only: {len(df.collect())}"
        except Exception as error:  # report and go on
            result, note = error, f"ERROR {type(error).__name__} {str(error)[:1200]}"
        bad += result is not None
        print(f"{time.time() - began:6.2f}s {name}: {note}", flush=True)
    print("failures", bad)
