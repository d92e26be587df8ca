"""Runs queries beside their SQL: python tests/compare.py [sf] [name...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    import datetime

    if x is None or isinstance(x, (str, bool, int)):
        return x
    if isinstance(x, float) or type(x).__name__.startswith("float"):
        return "nan" if math.isnan(x) else float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return sorted((str(k), plain(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "__iter__"):
        return [plain(v) for v in x]
    return plain(x.item()) if hasattr(x, "item") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def duck(d: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(d)):
        p = os.path.join(d, f) + ("/*.parquet" if os.path.isdir(os.path.join(d, f)) else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as e

    from allelora.session import get_spark

    spark = get_spark(master="local[8]", **{"spark.driver.memory": "10g", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/{sf}"
    con, queries, sql, bad = duck(d), e.queries(), e.oracle_sql(), 0
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, d)
            ours = rows_of(df.columns, df.collect())
            took = time.time() - t
            if name not in sql:
                print(f"{name}: {len(ours)} rows, no SQL, {took:.1f} s")
                continue
            t = time.time()
            cur = con.execute(sql[name])
            columns = [c[0] for c in cur.description]
            theirs = rows_of(columns, cur.fetchall())
            ok = sorted(columns) == sorted(df.columns) and ours == theirs
            bad += not ok
            print(f"{name}: {'ok' if ok else 'DIFFERENT'} {len(ours)} {len(theirs)} rows, {took:.1f} s, SQL {time.time() - t:.1f} s", flush=True)
            if not ok:
                print("  columns", sorted(df.columns), sorted(columns))
                a, b = set(ours), set(theirs)
                print("  only ours", sorted(a - b)[:3], "\n  only SQL", sorted(b - a)[:3])
        except Exception as x:
            bad += 1
            print(f"{name}: ERROR {str(x)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.01", sys.argv[2:]))
