"""Compare registered queries with their DuckDB statements on the same parquet files.

    python tests/oracle_check.py [prefix ...]     (SF_DIR picks the folder)
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ").removesuffix(" 00:00:00")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return float(v)


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(cols), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(a, b) -> bool:
    for x, y in zip(a, b):
        if x != y:
            return False
    return True


def check(name, spark, con, sf, queries, oracle):
    t0 = time.time()
    df = queries[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if name not in oracle:
        return "rows", len(got[1]), t1 - t0, 0.0, ""
    cur = con.execute(oracle[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    why = ""
    if got[0] != want[0]:
        why = f"columns {got[0]} vs {want[0]}"
    elif len(got[1]) != len(want[1]):
        why = f"rows {len(got[1])} vs {len(want[1])}"
    else:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if not same(a, b)]
        if bad:
            why = f"{len(bad)} rows differ {got[0]}: {bad[0][0]} vs {bad[0][1]}"
    return ("FAIL" if why else "ok"), len(got[1]), t1 - t0, t2 - t1, why


def main(prefixes):
    import __spark_entry__ as entry
    from lonja.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, q, o = duck(sf), entry.queries(), entry.oracle_sql()
    fails = []
    for name in q:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            st, n, a, b, why = check(name, spark, con, sf, q, o)
        except Exception as e:  # report and go on with the next query
            st, n, a, b, why = "ERROR", 0, 0.0, 0.0, str(e)[:700]
        if st in ("FAIL", "ERROR"):
            fails.append(name)
        flag = " EMPTY" if n == 0 else ""
        print(f"{st:5} {name:36} n={n:<7} spark={a:.1f}s duck={b:.1f}s{flag} {why[:700]}", flush=True)
    print("failed:", fails)


if __name__ == "__main__":
    main(sys.argv[1:])
