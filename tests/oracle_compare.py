"""Run registered queries in Spark and their oracle SQL in DuckDB and compare
row count, column names and an order-insensitive value hash.

    python tests/oracle_compare.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{round(v, 6):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


def compare(spark, sf_dir: str, keys: list[str] | None = None, verbose: bool = True) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for key in keys or list(qs):
        rec = {}
        t0 = time.time()
        try:
            df = qs[key](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
            rec.update(spark_rows=len(rows), spark_sec=round(time.time() - t0, 2))
        except Exception as e:  # noqa: BLE001
            rec["spark_error"] = repr(e)[:400]
            out[key] = rec
            if verbose:
                print(key, rec, flush=True)
            continue
        if key in sqls:
            t1 = time.time()
            try:
                res = con.execute(sqls[key])
                ocols = [d[0] for d in res.description]
                orows = res.fetchall()
                rec.update(oracle_rows=len(orows), oracle_sec=round(time.time() - t1, 2),
                           cols_match=sorted(cols) == sorted(ocols),
                           match=(len(rows) == len(orows) and sorted(cols) == sorted(ocols)
                                  and digest(cols, rows) == digest(ocols, orows)))
                if not rec["cols_match"]:
                    rec["cols"] = (cols, ocols)
            except Exception as e:  # noqa: BLE001
                rec["oracle_error"] = repr(e)[:400]
        else:
            rec["match"] = None
        out[key] = rec
        if verbose:
            print(key, rec, flush=True)
    return out


if __name__ == "__main__":
    from parindex import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v.get("match") is False or "spark_error" in v or "oracle_error" in v]
    print("SUMMARY", len(res), "keys;", sum(1 for v in res.values() if v.get("match")), "match;",
          "bad:", bad)
