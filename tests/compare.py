"""Runs queries in Spark and DuckDB and compares their rows."""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark, sf_dir: str, name: str, query, sql: str, con=None) -> str:
    """'' where Spark and DuckDB agree on columns and rows."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    out = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in out.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} against {sorted(names)}"
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=repr)
    if got == want:
        return "" if got else f"{name}: no rows on either side"
    for a, b in zip(got, want):
        if a != b:
            return f"{name}: {len(got)} rows against {len(want)}, first {a} against {b}"
    return f"{name}: {len(got)} rows against {len(want)}"


if __name__ == "__main__":
    import time

    import __spark_entry__ as e
    from quern.session import get_spark

    sf = sys.argv[1]
    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf), e.oracle_sql()
    for n, q in e.queries().items():
        if sys.argv[2:] and not any(n.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            said = difference(spark, sf, n, q, sqls[n], con) if n in sqls else f"{n}: no SQL, {q(spark, sf).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"{n}: {type(x).__name__} {str(x)[:600]}"
        print(f"{time.time() - t:.1f}s", said or f"{n}: equal", flush=True)
