"""Run registered queries on Spark and DuckDB and compare them row for row.

usage: python -m checks.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

import duckdb

from checks import catalog, registry  # noqa: F401
from odolake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(rows) -> list[tuple]:
    return sorted((tuple(None if v is None else v for v in r) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    query, oracle = registry.queries()[name], registry.oracle_sql().get(name)
    start = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = norm(df.select(*[f"`{c}`" for c in cols]).collect())
    took = time.time() - start
    if oracle is None:
        return True, f"rows={len(got)} {took:.1f}s (no SQL)"
    start = time.time()
    rel = con.execute(oracle)
    names = [d[0] for d in rel.description]
    idx = [names.index(c) for c in cols]
    want = norm(tuple(r[i] for i in idx) for r in rel.fetchall())
    duck = time.time() - start
    if sorted(names) != cols:
        return False, f"columns differ: {cols} vs {sorted(names)}"
    if got == want:
        return True, f"rows={len(got)} spark {took:.1f}s duck {duck:.1f}s" + ("  EMPTY" if not got else "")
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{cols}\n   spark {len(got)} rows, duck {len(want)} rows\n   spark only {only_got}\n   duck only {only_want}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    con = connect(sf_dir)
    bad = []
    known = list(registry.CHECKS)
    picked = [n for n in known if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    for name in picked:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:
            ok, note = False, "".join(traceback.format_exception_only(e))[:1500]
            if "--trace" in sys.argv:
                traceback.print_exc()
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(picked) - len(bad)} of {len(picked)} equal; failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
