"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None  # toPandas turns NULL in integer columns into NaN
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def canon(pdf: pd.DataFrame):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None)]
    rows.sort(key=repr)
    return cols, rows


def compare(spark_pdf, duck_pdf):
    c1, r1 = canon(spark_pdf)
    c2, r2 = canon(duck_pdf)
    if c1 != c2:
        return f"columns differ: {c1} vs {c2}"
    if len(r1) != len(r2):
        return f"row count {len(r1)} vs {len(r2)}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"
    return None


def main(argv):
    sys.path.insert(0, ".")
    from txguard.plans.registry import load_all
    from txguard.session import local_session
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    reg = load_all()
    con = duck(sf)
    fails = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sp = q.run(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            fails += 1
            continue
        t1 = time.time()
        sql = q.oracle()
        if sql is None:
            print(f"SKIP {name}: no oracle ({len(sp)} rows, {t1 - t0:.1f}s)")
            continue
        try:
            dk = con.sql(sql).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            fails += 1
            continue
        err = compare(sp, dk)
        if err:
            fails += 1
            print(f"FAIL {name}: {err}")
        else:
            print(f"ok   {name}: {len(sp)} rows ({t1 - t0:.1f}s)")
    print(f"{fails} failures")
    return fails


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
