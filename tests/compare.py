"""Run registered queries and their SQL side by side."""
from __future__ import annotations

import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return f"int {v}"
    if isinstance(v, Decimal):
        return f"dec {v}"
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, (date, datetime)):
        return str(v)
    return v


def key(row):
    return tuple((x is not None, str(type(x)), x if x is not None else "") for x in row)


def compare(name: str, df, sql: str, con, limit: int = 4) -> tuple[bool, str]:
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns differ: only spark {set(cols) - set(names)} only sql {set(names) - set(cols)}"
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=key)
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        return True, f"{len(got)} rows"
    text = []
    for g, w in bad[:limit]:
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b]
        text.append(f"{g[:2]}: {diff[:5]}")
    return False, f"{len(bad)} of {len(got)} rows differ\n   " + "\n   ".join(text)


def main(argv: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from bourseflow.session import local
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = local(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            ok, note = compare(name, df, oracle[name], con) if name in oracle else (True, f"{df.count()} rows, no SQL")
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t0:5.1f}s {note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
