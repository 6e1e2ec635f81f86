"""Run registered queries next to their SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return str(v) if v is not None else None

    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - start
    rel = con.execute(sql)
    want = normal(rel.fetchall(), [d[0] for d in rel.description])
    same = got == want
    note = ""
    if not same:
        a, b = set(got[0]), set(want[0])
        note = f" rows {len(got[0])} vs {len(want[0])}, columns {got[1]} vs {want[1]}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return same, len(got[0]), took, note


if __name__ == "__main__":
    import __spark_entry__ as entry
    from reqguard.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = local_session(8)
    con = duck(sf)
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        try:
            same, n, took, note = compare(spark, con, name, query, sqls[name], sf)
            print(f"{'ok  ' if same else 'DIFF'} {name} rows={n} {took:.2f}s{note[:1500]}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name} {str(e)[:600]}", flush=True)
