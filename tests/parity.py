"""Run registered queries against their SQL on the same tables."""

from __future__ import annotations

import datetime
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (bytes, bytearray, memoryview)):
        return bytes(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return None if sum(got.values()) else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (f"{sum(got.values())} rows, {sum(want.values())} wanted; cols {cols}\n   extra "
            f"{list(extra.items())[:2]}\n   missing {list(missing.items())[:2]}")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from logweave.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    only = sys.argv[1:]
    bad = 0
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            err = compare(spark, con, name, fn, entry.oracle_sql().get(name), sf)
        except Exception as e:  # noqa: BLE001
            err = f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        print(f"{'ok  ' if err is None else 'FAIL'} {name} {time.time() - t:.1f}s "
              f"{'' if name in entry.oracle_sql() else '(no sql)'} {err or ''}", flush=True)
    print("failures:", bad)
