"""Compares queries with their SQL: python tests/compare.py SF [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(f"{DATA}/{sf}").glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from '{src}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    got = rows_of(spark_df.columns, spark_df.collect())
    q = con.execute(sql)
    cols = [c[0] for c in q.description]
    want = rows_of(cols, q.fetchall())
    if sorted(cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(cols)}"
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return ""


def main() -> None:
    import __spark_entry__ as e
    from tidemark.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf)
    qs, sql = e.queries(), e.oracle_sql()
    for k in names or qs:
        t = time.time()
        try:
            df = qs[k](spark, f"{DATA}/{sf}")
            if k in sql:
                said = differences(df, con, sql[k]) or f"ok {con.execute(f'select count(*) from ({sql[k]})').fetchone()[0]}"
            else:
                said = f"rows {df.count()}"
        except Exception as x:  # noqa: BLE001
            said = "ERROR " + str(x)[:1500]
        print(f"{k}: {said} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
