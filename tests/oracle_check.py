"""Run registered queries in Spark and their oracle SQL in DuckDB and compare results.

Mirrors the driver's check: same column names, same row count, same multiset of rows
(floats compared after rounding to 9 significant digits).

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and type(v).__name__[:3] in ("int", "flo", "uin"):
        v = float(v)
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "tolist"):
        return str(v.tolist())
    if isinstance(v, (list, tuple)):
        return str(list(v))
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict[str, str]:
    import __spark_entry__ as E

    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    res = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            res[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:300]}"
            print(name, res[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in orc:
            res[name] = f"rows-only {len(sp)}"
            print(f"{name}: {res[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            dk = con.sql(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            res[name] = f"DUCKDB ERROR {str(e)[:400]}"
            print(name, res[name], flush=True)
            continue
        if sorted(sp.columns) != sorted(dk.columns):
            res[name] = f"COLUMNS spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
        elif len(sp) != len(dk):
            res[name] = f"ROWCOUNT spark={len(sp)} duck={len(dk)}"
        else:
            a, b = rows(sp), rows(dk)
            if a == b:
                res[name] = f"OK {len(sp)}"
            else:
                diff = [(x, y) for x, y in zip(a, b) if x != y]
                res[name] = f"VALUES {len(diff)} differ; first spark={diff[0][0]} duck={diff[0][1]}"
        if verbose:
            print(f"{name}: {res[name]} ({ts:.1f}s)", flush=True)
    return res


if __name__ == "__main__":
    from wholesail.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session()
    r = compare(spark, sf, names)
    bad = {k: v for k, v in r.items() if not (v.startswith("OK") or v.startswith("rows-only"))}
    print(f"\n{len(r) - len(bad)}/{len(r)} ok")
    for k, v in bad.items():
        print("FAIL", k, v[:500])
