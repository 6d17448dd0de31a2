"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, columns and an order-insensitive hash of
the values for both engines.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def digest(columns: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12]


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    t2 = time.time()
    same_cols = sorted(scols) == sorted(dcols)
    sh, dh = digest(scols, srows), digest(dcols, drows)
    ok = same_cols and len(srows) == len(drows) and sh == dh
    return {
        "name": name, "ok": ok, "rows": (len(srows), len(drows)), "cols_match": same_cols,
        "hash": (sh, dh), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
        "spark_cols": scols, "duck_cols": dcols, "srows": srows, "drows": drows,
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from pulseboard.session import build_session

    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_connect(sf_dir)
    qs, ors = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        if name not in ors:
            df = fn(spark, sf_dir)
            print(f"{name:34s} NO-ORACLE rows={df.count()}")
            continue
        r = compare(spark, con, name, fn, ors[name], sf_dir)
        flag = "OK  " if r["ok"] else "FAIL"
        bad += 0 if r["ok"] else 1
        print(f"{flag} {name:34s} rows={r['rows']} cols={r['cols_match']} hash={r['hash']} "
              f"spark={r['spark_s']}s duck={r['duck_s']}s", flush=True)
        if not r["ok"]:
            print("   spark cols", r["spark_cols"])
            print("   duck  cols", r["duck_cols"])
            for row in sorted(map(repr, r["srows"]))[:5]:
                print("   S", row)
            for row in sorted(map(repr, r["drows"]))[:5]:
                print("   D", row)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
