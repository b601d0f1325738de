"""Compare registered queries with their SQL on the shared tables.

Usage: python tests/check_oracles.py [sf_dir] [name-or-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_module  # noqa: E402
from tallystone.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if not isinstance(v, int) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows), sorted(columns)


def main(sf_dir, wanted):
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = build(spark, sf_dir)
            got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
            if name not in sql:
                print(f"ROWS  {name:40s} {len(got):8d} rows {time.time()-t0:6.2f}s")
                continue
            cur = con.execute(sql[name])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            exp, exp_cols = rows_of(cols, cur.fetchall())
            spark_types = dict(df.dtypes)
            pairs = {(spark_types[c], types[c]) for c in set(cols) & set(spark_types)}
            allowed = {("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("boolean", "BOOLEAN"), ("double", "DOUBLE"), ("date", "DATE"), ("timestamp", "TIMESTAMP")}
            odd = [p for p in pairs if p not in allowed]
            ok = got == exp and got_cols == exp_cols
            print(f"{'OK   ' if ok else 'FAIL '} {name:40s} {len(got):8d} rows {time.time()-t0:6.2f}s{'  types ' + str(odd) if odd else ''}")
            if not ok:
                bad.append(name)
                print("   cols", got_cols, exp_cols, "rows", len(got), len(exp))
                g, e = set(got), set(exp)
                print("   only spark:", sorted(g - e)[:3])
                print("   only sql  :", sorted(e - g)[:3])
        except Exception as ex:  # noqa: BLE001
            bad.append(name)
            print(f"ERROR {name}: {str(ex)[:300]}")
    print(f"{len(bad)} bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    sys.exit(main(sf, args[1:]))
