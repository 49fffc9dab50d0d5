"""Compare queries with their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    """A value that equal results have alike, whichever engine made it."""
    import datetime
    import decimal

    import numpy as np

    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, np.generic):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, name, query, sql, sf_dir) -> str:
    t = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    at = [names.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}: only here {[*set(a) - set(b)][:3]}, only SQL {[*set(b) - set(a)][:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} differ: {bad[:2]}" if bad else f"ok {len(a)} rows {took:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sf = connect(sys.argv[1]), sys.argv[1]
    sqls = e.oracle_sql()
    for k, f in e.queries().items():
        if sys.argv[2:] and k not in sys.argv[2:]:
            continue
        try:
            if k in sqls:
                print(k, compare(spark, con, k, f, sqls[k], sf), flush=True)
            else:
                t = time.time()
                n = f(spark, sf).collect()
                print(k, "no SQL", len(n), f"rows {time.time() - t:.1f} s", flush=True)
        except Exception as x:
            print(k, "FAILED", str(x)[:1500], flush=True)
