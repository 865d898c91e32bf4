"""Run a registered Spark query and its DuckDB oracle SQL and compare them:
row count, column names, and the order-insensitive multiset of rows.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(norm(x) for x in list(v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        f = float(v)
        if math.isnan(f):
            return "None"
        if f == int(f) and abs(f) < 1e15:
            return str(int(f))
        return repr(f)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    out.sort()
    return cols, out


def duck_type(t) -> str:
    """Spark type -> the DuckDB type name of the same values."""
    from pyspark.sql import types as T
    if isinstance(t, T.ArrayType):
        return duck_type(t.elementType) + "[]"
    names = {T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR",
             T.BooleanType: "BOOLEAN", T.TimestampNTZType: "TIMESTAMP", T.FloatType: "FLOAT"}
    return names.get(type(t), str(t))


def compare(spark, con, key, qfn, sql, sf_dir):
    t0 = time.time()
    frame = qfn(spark, sf_dir)
    stypes = {f.name: duck_type(f.dataType) for f in frame.schema.fields}
    sdf = frame.toPandas()
    t1 = time.time()
    rel = con.sql(sql) if sql else None
    ddf = rel.df() if sql else None
    t2 = time.time()
    res = {"key": key, "spark_rows": len(sdf), "spark_s": round(t1 - t0, 2)}
    if ddf is None:
        res["status"] = "rows-only"
        return res
    res["duck_rows"] = len(ddf)
    res["duck_s"] = round(t2 - t1, 2)
    sc, sr = rows_of(sdf)
    dc, dr = rows_of(ddf)
    dtypes = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if sc != dc:
        res["status"] = f"COLUMNS {sc} vs {dc}"
    elif stypes != dtypes:
        res["status"] = f"TYPES {[(n, stypes[n], dtypes.get(n)) for n in stypes if stypes[n] != dtypes.get(n)]}"
    elif sr != dr:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res["status"] = f"VALUES spark-only={diff_s} duck-only={diff_d}"
    else:
        res["status"] = "match"
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from urlsieve.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        try:
            r = compare(spark, con, k, qs[k], sqls.get(k), sf_dir)
        except Exception as exc:  # noqa: BLE001
            r = {"key": k, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("match", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
