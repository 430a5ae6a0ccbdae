"""Run registered queries against their SQL twins in DuckDB and compare values.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402
from catalog.base import TABLES  # noqa: E402
from opinara.session import local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return ("DECIMAL", str(v))
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else repr(float(v))
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf, key, query, sql):
    t0 = time.time()
    df = query(spark, sf)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    secs = time.time() - t0
    if sql is None:
        return True, f"rows only: {len(got[1])}", secs
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} / {want[0]}", secs
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} / {len(want[1])}", secs
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}", secs
    return True, f"{len(got[1])} rows equal", secs


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:]
    spark = local_session("oracle-check")
    con = connect(sf)
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    failed = []
    for key, query in queries.items():
        if keys and key not in keys:
            continue
        try:
            ok, note, secs = compare(spark, con, sf, key, query, oracles.get(key))
        except Exception as e:  # noqa: BLE001
            ok, note, secs = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {key:28s} {secs:6.2f}s  {note}", flush=True)
        if not ok:
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
