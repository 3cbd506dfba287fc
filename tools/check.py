"""Run registered queries against their DuckDB oracles.

usage: python tools/check.py [sf_dir] [regex ...]
"""

from __future__ import annotations

import math
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from memlake.plans import all_queries, registry  # noqa: E402
from memlake.session import build_session  # noqa: E402
from memlake.sources.fixtures import RAW  # noqa: E402

KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(float(v))
    return str(v)


def compare(df, con, sql: str) -> list[str]:
    """Problems found, empty when both sides agree."""
    got = df.collect()
    rel = con.sql(sql)
    want_cols = dict(zip(rel.columns, [str(x) for x in rel.types]))
    rows = rel.fetchall()
    problems = []
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(got_types) != sorted(want_cols):
        return [f"columns {sorted(got_types)} vs {sorted(want_cols)}"]
    for c, ty in got_types.items():
        if KIND.get(ty, ty) != want_cols[c]:
            problems.append(f"type {c}: {ty} vs {want_cols[c]}")
    cols = sorted(got_types)
    idx = {c: i for i, c in enumerate(rel.columns)}
    a = sorted(tuple(_cell(r[c]) for c in cols) for r in got)
    b = sorted(tuple(_cell(r[idx[c]]) for c in cols) for r in rows)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"cols {cols}")
        problems.append(f"only spark {len(sa - sb)}: {sorted(sa - sb)[:3]}")
        problems.append(f"only sql   {len(sb - sa)}: {sorted(sb - sa)[:3]}")
    if not a:
        problems.append("EMPTY")
    return problems


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session("check", memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    qs = all_queries()
    con = connect(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if args and not any(re.search(p, name) for p in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in registry.ORACLES:
                problems, n = compare(df, con, registry.ORACLES[name]), ""
            else:
                n = df.count()
                problems = [] if n else ["EMPTY"]
                n = f"rows-only {n}"
        except Exception as e:  # report and go on to the next query
            problems, n = [type(e).__name__ + ": " + str(e)[:1500]], ""
        took = time.time() - t0
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {took:.1f}s {n}", flush=True)
        for p in problems:
            print("     ", p[:1600])
    print("failures:", bad)


if __name__ == "__main__":
    main()
