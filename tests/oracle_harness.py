"""Compare each registered Spark query with its DuckDB oracle.

Usage: python tests/oracle_harness.py [sf_dir] [query ...]
Row count, column names and an order-insensitive value hash must agree.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_digest(pdf):
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(repr([_norm(x) for x in rec]))
    rows.sort()
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h, rows


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as entry

    qs = entry.queries()
    sqls = entry.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # report and continue
            results[name] = ("spark-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} SPARK ERROR {str(e)[:400]}")
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = ("rows-only", len(sdf))
            if verbose:
                print(f"{name:28s} rows-only {len(sdf)} rows  spark {t1 - t0:.1f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as e:
            results[name] = ("oracle-error", str(e)[:400])
            if verbose:
                print(f"{name:28s} ORACLE ERROR {str(e)[:400]}")
            continue
        sc, sn, sh, srows = frame_digest(sdf)
        oc, on, oh, orows = frame_digest(odf)
        ok = sc == oc and sn == on and sh == oh
        results[name] = ("ok" if ok else "MISMATCH", sn, on)
        if verbose:
            print(f"{name:28s} {'ok' if ok else 'MISMATCH'} rows spark={sn} oracle={on}  spark {t1 - t0:.1f}s")
            if not ok:
                if sc != oc:
                    print("   cols spark:", sc, "\n   cols oracle:", oc)
                only_s = sorted(set(srows) - set(orows))[:3]
                only_o = sorted(set(orows) - set(srows))[:3]
                for r in only_s:
                    print("   spark-only:", r[:300])
                for r in only_o:
                    print("   oracle-only:", r[:300])
    return results


if __name__ == "__main__":
    from graphmend.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows-only")]
    print("FAILED:", bad if bad else "none", f"({len(res)} queries)")
