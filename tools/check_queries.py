"""Run registered queries next to their DuckDB checks: python tools/check_queries.py [sf_dir] [key prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duewise.queries.catalog import SPECS  # noqa: E402
from duewise.session import build_session  # noqa: E402


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(row[i]) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, sf_dir: str, key: str):
    spec = SPECS[key]
    start = time.time()
    df = spec.run(spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    took = time.time() - start
    if spec.oracle is None:
        return True, f"rows only, n={len(got)}", took
    start = time.time()
    cur = con.execute(spec.oracle)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    duck = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns differ: only spark {set(df.columns) - set(names)}, only sql {set(names) - set(df.columns)}", took
    kinds = {c[0]: str(c[1]) for c in cur.description}
    weird = [f"{n}:{k}" for n, k in kinds.items() if k not in ("BIGINT", "DOUBLE", "VARCHAR", "BOOLEAN")]
    a, b = normal(got, df.columns), normal(want, names)
    note = f"n={len(a)} duck={duck:.1f}s" + (f" TYPES {weird}" if weird else "")
    if a == b:
        return True, note, took
    diff = [(p, q) for p, q in zip(a, b) if p != q]
    cols = sorted(df.columns)
    detail = ""
    if diff:
        p, q = diff[0]
        detail = f" first: {[(c, u, v) for c, u, v in zip(cols, p, q) if u != v][:4]} of {p[:3]}"
    return False, f"MISMATCH {note} want={len(b)} differing={len(diff)}{detail}", took


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session(cores="8")
    duck = connect(sf)
    failed = []
    for key in sorted(SPECS):
        if wanted and not any(key.startswith(w) for w in wanted):
            continue
        try:
            ok, note, took = compare(session, duck, sf, key)
        except Exception as error:  # noqa: BLE001
            ok, note, took = False, f"ERROR {str(error)[:700]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {key:40s} {took:6.2f}s {note}", flush=True)
        if not ok:
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")
