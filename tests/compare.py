"""Run registered queries against their SQL: `python tests/compare.py [folder] [name ...]`."""

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def value(v):
    """One form for the values of both engines."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal)) and v == int(v):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return int(v) if float(v).is_integer() else round(float(v), 9)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return repr(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return canonical(names, result.fetchall())


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def main(folder, names):
    from articlelake.plans import REGISTRY
    from articlelake.session import local_session

    spark = local_session("8")
    bad = 0
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            cols, rows = spark_rows(q.run(spark, folder))
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            ocols, orows = oracle(folder, q.sql)
            if cols != ocols:
                bad += 1
                print(f"COLS  {name} {cols} / {ocols}", flush=True)
            elif rows != orows:
                bad += 1
                print(f"DIFF  {name} {len(rows)} / {len(orows)}", flush=True)
                mine, theirs = set(map(repr, rows)), set(map(repr, orows))
                for r in sorted(mine - theirs)[:3]:
                    print("   spark ", r[:700])
                for r in sorted(theirs - mine)[:3]:
                    print("   duckdb", r[:700])
            else:
                print(f"ok    {name} {len(rows)} {took:.1f}s" + (" EMPTY" if not rows else ""), flush=True)
        except Exception as error:
            bad += 1
            print(f"FAIL  {name} {type(error).__name__} {str(error)[:1200]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:])
