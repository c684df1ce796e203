"""Run registered queries next to their SQL checks and compare the results."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(df, con, sql: str):
    """None when equal, else a short account of the first differences."""
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    if len(got) != len(want):
        gs, ws = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; only spark {list(gs - ws)[:2]}; only sql {list(ws - gs)[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        gs, ws = set(got), set(want)
        return f"{len(gs - ws)} of {len(got)} rows differ; cols {cols}; spark {sorted(gs - ws, key=str)[:2]}; sql {sorted(ws - gs, key=str)[:2]}"
    types = [type(x).__name__ for x in (got[0] if got else ())]
    return None if not any(t in ("Decimal", "list", "dict", "Row") for t in types) else f"types {types}"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = make_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(a in n for a in argv)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
            else:
                n = df.count()
                verdict = None if n else "no rows"
        except Exception as exc:  # report and go on
            verdict = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {time.time() - start:6.2f}s {name} {'' if name in oracles else '(rows only)'} {verdict or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
