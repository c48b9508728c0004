"""Compares every registered query with its SQL in DuckDB. Usage: oracle_check.py [sf_dir] [query ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return v
        if isinstance(v, float):
            return int(v) if math.isfinite(v) and v == int(v) else v
        if isinstance(v, (dt.datetime, dt.date)):
            return v.isoformat()
        return v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    theirs, names = cur.fetchall(), [c[0] for c in cur.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(set(df.columns) ^ set(names))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = canonical(df.columns, ours), canonical(names, theirs)
    if not a:
        return "empty result"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        cols = sorted(df.columns)
        x, y = wrong[0]
        return f"{len(wrong)} rows differ, e.g. " + ", ".join(
            f"{c}: {p!r} vs {q!r}" for c, p, q in zip(cols, x, y) if p != q)
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o, bad = connect(sf_dir), queries(), oracle_sql(), 0
    q = {n: f for n, f in q.items() if n in o or n in sys.argv}
    for name in sys.argv[2:] or q:
        start = time.time()
        try:
            diff = compare(spark, con, name, q[name], o[name], sf_dir) if name in o else "no SQL"
        except Exception as err:  # report and go on with the next query
            diff = f"{type(err).__name__}: {str(err)[:600]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
