"""Runs registered queries against their SQL in DuckDB: `python tests/oracle.py [sf_dir] [name…]`."""

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(e) for e in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return list(pdf.columns), sorted(rows, key=lambda r: tuple((v is not None, str(type(v).__name__ != "str"), str(v)) for v in r))


def compare(got, want):
    """Empty text when both tables hold the same rows; numbers must be equal."""
    ca, a = rows_of(got)
    cb, b = rows_of(want)
    if ca != cb:
        return f"columns {ca} vs {cb}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, such as\n  {bad[0][0]}\n  {bad[0][1]}" if bad else ""


def main():
    from __spark_entry__ import oracle_sql, queries
    from trackgeo.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session("8", "oracle")
    con = connect(sf)
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if not args or any(n.startswith(a) for a in args)]
    failed = []
    for name in names:
        start = time.time()
        try:
            got = qs[name](spark, sf).toPandas()
            took = time.time() - start
            note = "rows only"
            if name in sqls:
                t1 = time.time()
                note = compare(got, con.execute(sqls[name]).df()) or f"equal (sql {time.time() - t1:.1f}s)"
            ok = note.startswith(("equal", "rows only"))
            print(f"{'ok ' if ok else 'BAD'} {name} {len(got)} rows {took:.1f}s {note}", flush=True)
        except Exception as e:  # noqa: BLE001
            ok = False
            print(f"ERR {name} {type(e).__name__} {str(e)[:1500]}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
