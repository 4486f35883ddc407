"""Run registered queries and their SQL forms side by side and report differences.

python tools/compare.py [--sf DIR] [--only REGEX] [--module NAME]
"""

import argparse
import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--only", default=".")
    parser.add_argument("--module")
    args = parser.parse_args()
    from corpusgate import plans
    from corpusgate.session import build_session
    if args.module:
        plans._MODULES = tuple(args.module.split(","))
    spark = build_session(master="local[8]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions="8", spark__driver__memory="12g",
                          spark__driver__extraJavaOptions="-Dlog4j2.level=OFF",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{args.sf}/{name}.parquet'")
    bad = []
    for name, q in plans.registry().items():
        if not re.search(args.only, name):
            continue
        start = time.time()
        try:
            df = q.build(spark, args.sf)
            cols = sorted(df.columns)
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name}: {str(e)[:1500]}")
            bad.append(name)
            continue
        took = time.time() - start
        if q.sql is None:
            print(f"rows {name}: {len(rows)} {took:.1f}s")
            continue
        try:
            cur = con.execute(q.sql)
            names = [c[0] for c in cur.description]
            found = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"SQL  {name}: {str(e)[:700]}")
            bad.append(name)
            continue
        if sorted(names) != cols:
            print(f"COLS {name}: spark {cols} sql {sorted(names)}")
            bad.append(name)
            continue
        at = [names.index(c) for c in cols]
        want = [tuple(norm(r[i]) for i in at) for r in found]
        key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
        a, b = sorted(rows, key=key), sorted(want, key=key)
        types = [(type(x).__name__, type(y).__name__) for x, y in zip(a[0], b[0])] if a and b else []
        odd = [(c, t) for c, t in zip(cols, types) if t[0] != t[1] and "NoneType" not in t]
        if a == b and not odd:
            print(f"ok   {name}: {len(a)} rows {took:.1f}s")
        else:
            bad.append(name)
            only_a, only_b = set(a) - set(b), set(b) - set(a)
            print(f"DIFF {name}: spark {len(a)} sql {len(b)} types {odd}\n   cols {cols}\n   spark only "
                  f"{len(only_a)} {str(list(only_a)[:3])[:700]}\n   sql only {len(only_b)} {str(list(only_b)[:3])[:700]}")
    print("BAD", bad)


main()
