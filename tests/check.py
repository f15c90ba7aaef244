"""Compare registered queries with their SQL in DuckDB: python tests/check.py <sf> [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sf: str) -> tuple[str, float, float]:
    t0 = time.time()
    df = query.build(spark, f"{DATA}/{sf}")
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if query.sql is None:
        return f"rows only: {len(got)}", t1 - t0, 0.0
    cur = con.execute(query.sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = _rows(cols, cur.fetchall())
    t2 = time.time()
    if sorted(df.columns) != sorted(cols):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}", t1 - t0, t2 - t1
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if t in names and names[t] != types[c]:
            return f"TYPE {c}: {t} != {types[c]}", t1 - t0, t2 - t1
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"DIFF rows {len(got)} vs {len(want)} {sorted(cols)} {diff}", t1 - t0, t2 - t1
    return f"ok {len(got)}" + ("" if got else " EMPTY"), t1 - t0, t2 - t1


def main(argv):
    from evalgrid.plans import load_all
    from evalgrid.session import local_session

    sf, only = argv[0], argv[1:]
    spark = local_session(8)
    con = duck(sf)
    bad = 0
    for name, q in load_all().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            res, a, b = compare(spark, con, name, q, sf)
        except Exception as e:  # report and go on
            res, a, b = f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0
        bad += not res.startswith(("ok", "rows"))
        print(f"{name:32s} spark {a:6.2f}s duck {b:6.2f}s  {res[:900]}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
