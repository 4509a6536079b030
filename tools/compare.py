"""Runs registered queries on Spark and their SQL twins on DuckDB and compares."""

from __future__ import annotations

import argparse
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{v + 0.0:.6f}"
    if isinstance(v, int):
        return f"{v}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = {}
    out = []
    for r in rows:
        out.append(tuple(canon(r[i]) for i in order))
        for i in order:
            if r[i] is not None:
                kinds.setdefault(columns[i], type(r[i]).__name__)
    return [columns[i] for i in order], sorted(out), kinds


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--dir", default="/root/testdata/sf0.01")
    ap.add_argument("--explain", action="store_true")
    args = ap.parse_args()

    import duckdb

    from convoeval.plans import ORACLES, QUERIES
    from convoeval.session import build_session

    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.dir}/{t}.parquet')")
    names = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.dir)
            if args.explain:
                df.explain("formatted")
            got = df.collect()
            took = time.time() - start
            plan = df._jdf.queryExecution().executedPlan().toString()
            flags = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]
            cols, left, kl = rows_of(df.columns, got)
        except Exception as exc:  # report and go on
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__}: {str(exc)[:700]}")
            continue
        if name not in ORACLES:
            print(f"rows {name}: {len(left)} rows {took:.1f}s {flags or ''}")
            continue
        try:
            cur = con.execute(ORACLES[name])
            oc = [x[0] for x in cur.description]
            ocols, right, kr = rows_of(oc, cur.fetchall())
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: SQL {str(exc)[:700]}")
            continue
        ok = cols == ocols and left == right
        kinds = {c: (kl.get(c), kr.get(c)) for c in cols if kl.get(c) != kr.get(c)}
        print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(left)} rows {took:.1f}s {flags or ''} {kinds or ''}")
        if not ok:
            bad += 1
            if cols != ocols:
                print("   columns", cols, ocols)
            a, b = set(left), set(right)
            print("   rows", len(left), len(right))
            for x in sorted(a - b)[:3]:
                print("   spark only", str(x)[:400])
            for x in sorted(b - a)[:3]:
                print("   sql only  ", str(x)[:400])
    print("bad:", bad, "of", len(names))
    spark.stop()
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
