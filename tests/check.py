"""Run registered queries and their SQL twins side by side and report differences.

    python tests/check.py [--sf 0.01] [--only substring ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(row[i]) for i in order) for row in rows)


def compare(spark, con, name, run, sql, sf_dir):
    """Returns (status, detail, seconds)."""
    started = time.time()
    df = run(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    took = time.time() - started
    if sql is None:
        return "ROWS", f"{len(rows)} rows", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = [str(d[1]) for d in cur.description]
    other = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLS", f"spark {sorted(set(df.columns) - set(names))} oracle {sorted(set(names) - set(df.columns))}", took
    mine = table(df.columns, rows)
    theirs = table(names, other)
    want = dict(zip(names, kinds))
    bad = [f"{c}:{t}/{want[c]}" for c, t in df.dtypes if TYPES.get(t, t) != want[c]]
    if mine != theirs:
        cols = sorted(names)
        in_a, in_b = set(mine), set(theirs)
        only_a = [x for x in mine if x not in in_b][:2]
        only_b = [x for x in theirs if x not in in_a][:2]
        return "DIFF", f"{len(mine)} vs {len(theirs)} rows\n   cols   {cols}\n   spark  {only_a}\n   oracle {only_b}\n   types {bad}", took
    if bad:
        return "TYPE", ", ".join(bad), took
    return ("OK" if mine else "EMPTY"), f"{len(mine)} rows", took


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", nargs="*", default=[])
    args = ap.parse_args()
    import __spark_entry__ as entry
    from lumenlog.session import build_session

    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    totals = {}
    for name, run in entry.queries().items():
        if args.only and not any(o in name for o in args.only):
            continue
        print(f"....   {name}", file=sys.stderr, flush=True)
        try:
            status, detail, took = compare(spark, con, name, run, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, detail, took = "ERR", f"{type(e).__name__}: {str(e)[:900]}", 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        totals[status] = totals.get(status, 0) + 1
        if status not in ("OK",) or args.only or took > 4:
            print(f"{status:6s} {name:40s} {took:6.2f}s {detail}", flush=True)
    print(totals)


if __name__ == "__main__":
    main()
