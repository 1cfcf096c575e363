"""Run registered queries and their SQL over the same tables and compare.

    python tests/oracle.py [folder] [query ...]
"""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry


def connect(folder):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(repr(row[i]) for i in order) for row in rows))


def compare(spark, db, name, folder):
    """None if Spark and SQL agree, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    result = db.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    extra, missing = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
    return f"rows {len(got[1])} != {len(want[1])}; only Spark {extra}; only SQL {missing}"


if __name__ == "__main__":
    from tidemark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(folder), 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = compare(spark, db, name, folder)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:26s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed of {len(sys.argv[2:]) or len(entry.queries())}; {len(entry.oracle_sql())} with SQL")
