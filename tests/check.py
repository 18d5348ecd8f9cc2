"""Compare every registered query with its SQL in DuckDB: ``python tests/check.py SF [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from mailrisk.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")):
        f = float(v)
        return str(int(f)) if f == int(f) else repr(f)
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in data)


def main() -> None:
    sf = sys.argv[1]
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            t0 = time.time()
            df = fn(spark, folder)
            got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            t1 = time.time()
            if name not in oracle:
                print(f"rows {name:32s} {len(got):7d} {t1 - t0:6.2f}s", flush=True)
                continue
            rel = con.sql(oracle[name])
            want_cols, want = rows_of(rel.columns, rel.fetchall())
            t2 = time.time()
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: {type(exc).__name__} {str(exc)[:600]}", flush=True)
            continue
        same = got_cols == want_cols and got == want
        bad += not same
        print(f"{'ok  ' if same else 'DIFF'} {name:32s} {len(got):7d} {t1 - t0:6.2f}s {t2 - t1:6.2f}s",
              flush=True)
        if not same:
            print("   cols", got_cols, want_cols)
            print("   rows", len(got), len(want))
            only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
            for a in only:
                for r in a:
                    print("    ", r)
                print("     --")
    print("problems:", bad)


if __name__ == "__main__":
    main()
