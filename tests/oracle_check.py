"""Run named queries on Spark and their SQL on DuckDB, and compare rows. ``python tests/oracle_check.py [sf] [name…]``"""

from __future__ import annotations

import glob
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from lorekeep.session import local_session  # noqa: E402


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, int):
        return float(value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 9)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> tuple[str, float, int]:
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows only", took, len(got)
    cursor = con.execute(sql)
    want = cursor.fetchall()
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of([c[0] for c in cursor.description], want)
    if gc != wc:
        return f"COLUMNS {gc} != {wc}", took, len(got)
    if gr != wr:
        extra, missing = list((gr - wr).items())[:2], list((wr - gr).items())[:2]
        return f"ROWS {len(got)} vs {len(want)}; spark only {extra}; sql only {missing}", took, len(got)
    return "ok", took, len(got)


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    con.execute("SET TimeZone = 'UTC'")
    return con


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = args[1:]
    bad = 0
    for name in entry.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            verdict, took, n = compare(spark, con, name, folder)
        except Exception as error:  # report and go on with the rest
            verdict, took, n = "ERROR " + str(error)[:1200], 0.0, 0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:34} {took:6.2f}s {n:7} {verdict}", flush=True)
    print("bad:", bad)
