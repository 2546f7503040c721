"""Run registered queries and compare them with their SQL counterparts.

    python tests/check.py [name-part ...] [--sf 0.01] [--plan]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_frame(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with sorted columns, plain values, in a fixed order."""
    df = df[sorted(df.columns)]

    def plain(v):
        if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if type(v).__name__.startswith(("int", "Int", "uint")):
            return int(v)
        if type(v).__name__ in ("float64", "float32", "float", "Decimal"):
            return float(v)
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        return str(v)

    rows = [tuple(plain(v) for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for x, y in zip(a, b):
        if len(x) != len(y) or any(not same(p, q) for p, q in zip(x, y)):
            return f"row {x} != {y}"
    return None


def same(p, q) -> bool:
    if isinstance(p, float) and isinstance(q, int) or isinstance(p, int) and isinstance(q, float):
        return float(p) == float(q)
    return p == q


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--plan", action="store_true")
    parser.add_argument("--sql", action="store_true", help="only queries with a SQL counterpart")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from tabwright.session import local_session

    spark = local_session(8)
    folder = f"/root/testdata/sf{args.sf}"
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(n in name for n in args.names) or args.sql and name not in oracles:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if args.plan:
                df.explain("formatted")
            got = df.toPandas()
            took = time.time() - start
            if name in oracles:
                start = time.time()
                problem = difference(got, oracle_frame(oracles[name], folder))
                state = "ok" if problem is None else "DIFF " + problem[:600]
            else:
                state = f"rows {len(got)}" if len(got) else "EMPTY"
            print(f"{name:36s} {took:6.2f}s {time.time() - start:6.2f}s {len(got):7d} {state}", flush=True)
            bad += state.startswith(("DIFF", "EMPTY"))
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"{name:36s} ERROR {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
