"""Local stand-in for the driver's correctness gate: run a registered Spark
query and its DuckDB oracle on the same parquet tables and compare row
count, column names and the order-insensitive multiset of values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tieout.sources.tables import TABLES, table_path  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


STRICT = os.environ.get("ORACLE_STRICT") == "1"  # bit-exact floats, as a strict value hash would be


def _norm(v):
    if v is None:
        return ("null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("null",)
        return ("f", repr(v) if STRICT else round(v, 6))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", repr(float(v)) if STRICT else float(v))
    return ("s", str(v))


def compare(spark, name: str, fn, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    con = duck(sf_dir)
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    out["cols_ok"] = sorted(s_cols) == sorted(d_cols)
    if not out["cols_ok"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["ok"] = False
        return out
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sn = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=repr)
    dn = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=repr)
    out["values_ok"] = sn == dn
    if not out["values_ok"]:
        ss, ds = set(sn), set(dn)
        out["only_spark"] = [list(zip(order, r)) for r in list(ss - ds)[:3]]
        out["only_oracle"] = [list(zip(order, r)) for r in list(ds - ss)[:3]]
    out["ok"] = out["values_ok"] and len(s_rows) == len(d_rows)
    return out


if __name__ == "__main__":
    import json

    import __spark_entry__ as E
    from tieout.session import build_session

    sf = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
    only = sys.argv[1:]
    spark = build_session()
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf).count()
            print(json.dumps({"name": name, "rows_only": n, "sec": round(time.time() - t0, 2)}))
            continue
        try:
            res = compare(spark, name, fn, sqls[name], sf)
        except Exception as e:  # noqa: BLE001
            res = {"name": name, "ok": False, "error": repr(e)[:800]}
        bad += not res["ok"]
        print(json.dumps(res, default=str))
    print("FAILED", bad)
