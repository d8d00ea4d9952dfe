"""Compare registered queries with their SQL on a table folder.

Run by hand: ``python tests/compare.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "" if value is None else f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, sf_dir: str):
    """``None`` when both sides agree, else a short account."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    t0 = time.time()
    ours = [tuple(r) for r in df.collect()]
    t1 = time.time()
    con.execute(oracle_sql()[name])
    columns = [d[0] for d in con.description]
    theirs = con.fetchall()
    t2 = time.time()
    timing = f"{len(ours)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", timing
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    if a != b:
        sa, sb = set(a), set(b)
        left, right = sorted(sa - sb)[:2], sorted(sb - sa)[:2]
        return f"rows {len(a)}/{len(b)}\n  spark {left}\n  sql   {right}", timing
    return None, timing


def main() -> None:
    from __spark_entry__ import oracle_sql

    from parapet.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names or oracle_sql():
        try:
            wrong, timing = differences(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            wrong, timing = f"{type(e).__name__}: {str(e)[:1500]}", ""
        print(("ok  " if wrong is None else "BAD ") + name, timing, wrong or "", flush=True)


if __name__ == "__main__":
    main()
