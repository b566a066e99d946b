"""Run named queries beside their SQL check: `python tests/check.py [prefix ...]`."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, int):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def compare(spark_df, con, sql):
    cols = sorted(spark_df.columns)
    left = sorted("|".join(_cell(r[c]) for c in cols) for r in spark_df.collect())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}", len(left)
    pos = [names.index(c) for c in cols]
    right = sorted("|".join(_cell(r[i]) for i in pos) for r in rel.fetchall())
    if left == right:
        return None, len(left)
    a, b = set(left) - set(right), set(right) - set(left)
    return f"rows {len(left)} vs {len(right)}; spark-only {sorted(a)[:3]}; sql-only {sorted(b)[:3]}", len(left)


def main(prefixes):
    import __spark_entry__ as e
    from tradewright.session import build_session
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(folder)
    queries, checks = e.queries(), e.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            if name in checks:
                diff, n = compare(build(spark, folder), con, checks[name])
            else:
                diff, n = None, len(build(spark, folder).collect())
            state = "ok " if diff is None else "DIFF"
            if name not in checks:
                state = "rows"
            bad += diff is not None
            print(f"{state} {name} n={n} {time.time() - t:.1f}s {(diff or '')[:900]}", flush=True)
            if n == 0:
                print(f"  EMPTY {name}")
        except Exception as exc:  # report every failing query in one pass
            bad += 1
            text = str(exc) if os.environ.get("FULL") else str(exc)[:700]
            print(f"FAIL {name} {type(exc).__name__} {text}", flush=True)
            if os.environ.get("FULL"):
                traceback.print_exc()
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
