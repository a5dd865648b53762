"""Compare registered queries with their oracle SQL; also runnable: python tests/oracle.py SF [name...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TESTDATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, query, sql, sf_dir) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    mine, my_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    theirs, their_cols = rows_of(rel.columns, rel.fetchall())
    if my_cols != their_cols:
        return False, f"columns {my_cols} vs {their_cols}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        diff = [x for x in mine if x not in b][:2], [x for x in theirs if x not in a][:2]
        return False, f"{len(mine)} vs {len(theirs)} rows; {diff}"[:1500]
    return True, f"{len(mine)} rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"{TESTDATA}/sf{sys.argv[1]}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = [n for n in entry.queries() if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in entry.oracle_sql():
                ok, note = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
            else:
                ok, note = True, f"{entry.queries()[name](spark, sf_dir).count()} rows, no oracle"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - began:.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
