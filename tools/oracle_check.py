"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

Usage: python tools/oracle_check.py [sf_dir] [name ...]

Comparison: row count, sorted column names, and the multiset of rows
(values normalised to text; floats exactly, with a note when they only
differ beyond 1e-9).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from cellframe.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float) or isinstance(v, np.floating):
        v = float(v)
        if math.isnan(v):
            return "nan"
        if v == 0 and not os.environ.get("KEEP_NEG_ZERO"):
            v = 0.0
        return repr(v)
    if isinstance(v, (np.integer, int)) and not isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if v is pd.NaT:
        return "∅"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    out.sort()
    return out


def compare(sdf: pd.DataFrame, ddf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(sdf.columns) != sorted(ddf.columns):
        return False, f"columns differ: spark={sorted(sdf.columns)} duck={sorted(ddf.columns)}"
    if len(sdf) != len(ddf):
        return False, f"row count spark={len(sdf)} duck={len(ddf)}"
    # integers with nulls come as floats from one engine and as a nullable type from the other
    whole = [c for c in ddf.columns if str(ddf[c].dtype) == "Int64" and sdf[c].dtype == "float64"]
    a, b = rows(sdf), rows(ddf.astype(dict.fromkeys(whole, "float64")))
    if a == b:
        return True, f"{len(a)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    close = True
    for x, y in bad:
        for u, v in zip(x, y):
            if u != v:
                try:
                    if not math.isclose(float(u), float(v), rel_tol=1e-9, abs_tol=1e-12):
                        close = False
                except ValueError:
                    close = False
    msg = f"{len(bad)} row diffs ({'float-close' if close else 'REAL'}); first: {bad[0][0]} vs {bad[0][1]}"
    return False, msg


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    from cellframe.plans.registry import ORACLES, QUERIES, load_all
    from cellframe.session import local_session
    load_all()
    plain = "--plain" in args
    args = [a for a in args if a != "--plain"]
    names = args or list(QUERIES)
    if plain:  # a session with Spark's defaults only, like an unknown driver
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.ui.showConsoleProgress", "false").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = local_session(8, 8)
    con = duck(sf_dir)
    ok_all = True
    for name in names:
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name:28s} spark error: {str(e).splitlines()[0][:300]}")
            ok_all = False
            continue
        ts = time.time() - t0
        if name not in ORACLES:
            print(f"ROWS  {name:28s} {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            ddf = con.execute(ORACLES[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name:28s} duckdb error: {str(e).splitlines()[0][:300]}")
            ok_all = False
            continue
        ok, msg = compare(sdf, ddf)
        ok_all &= ok
        print(f"{'OK  ' if ok else 'DIFF'}  {name:28s} {msg} {ts:.1f}s", flush=True)
    spark.stop()
    sys.exit(0 if ok_all else 1)


if __name__ == "__main__":
    main()
