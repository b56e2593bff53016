"""Side-by-side check of registered queries: Spark result versus DuckDB oracle.

Compares row count, column names and an order-insensitive hash of the values,
the same three things the correctness gate records.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import time

from pyspark.sql import SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ")
    return str(v)


def table_hash(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\x1e")
    return h.hexdigest()


SPARK_TO_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN",
                 "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark: SparkSession, sf_dir: str, names: list[str] | None = None, verbose: bool = True):
    from repolens.plans.registry import REGISTRY

    con = duck(sf_dir)
    results = {}
    for name, reg in REGISTRY.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = reg.run(spark, sf_dir)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = {"ok": False, "error": f"spark: {e}"[:800]}
            if verbose:
                print(name, "SPARK ERROR", str(e)[:800])
            continue
        t1 = time.time()
        out = {"rows": len(rows), "spark_sec": round(t1 - t0, 2)}
        if reg.oracle is None:
            out["ok"] = None
        else:
            try:
                cur = con.execute(reg.oracle)
                ocols = [d[0] for d in cur.description]
                orows = cur.fetchall()
            except Exception as e:  # noqa: BLE001
                results[name] = {**out, "ok": False, "error": f"duckdb: {e}"[:800]}
                if verbose:
                    print(name, "DUCKDB ERROR", str(e)[:800])
                continue
            out["oracle_rows"] = len(orows)
            out["cols_match"] = sorted(cols) == sorted(ocols)
            otypes = {d[0]: d[1] for d in con.execute(f"DESCRIBE {reg.oracle}").fetchall()}
            stypes = dict(df.dtypes)
            out["types_match"] = all(SPARK_TO_DUCK.get(stypes[c], stypes[c]) == otypes.get(c) for c in stypes)
            out["hash_match"] = table_hash(cols, rows) == table_hash(ocols, orows)
            out["ok"] = out["cols_match"] and out["types_match"] and out["hash_match"] and len(rows) == len(orows)
            if not out["cols_match"]:
                out["cols"] = (cols, ocols)
        results[name] = out
        if verbose:
            print(name, out, flush=True)
    return results


if __name__ == "__main__":
    import sys

    import tempfile

    from repolens.plans.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = get_session("local[8]", 8, checkpoint_dir=tempfile.mkdtemp(prefix="repolens-"))
    res = compare(spark, sf, only)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("FAILED:", bad)
