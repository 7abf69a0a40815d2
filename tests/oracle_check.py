"""Compare registered queries with their SQL on one directory of tables.

Usage: python tests/oracle_check.py [sf_dir] [name or name-prefix* ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normalise(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(normalise(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(normalise(r[i]) for i in order) for r in data]
    return names, sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


FAMILY = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def type_notes(df, con, sql):
    """Columns whose Spark and SQL types differ."""
    want = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [(c, t, want.get(c)) for c, t in df.dtypes if FAMILY.get(t, t) != want.get(c)]


def compare(df, con, sql):
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        types = [(type(a).__name__, type(b).__name__) for a, b in zip(*bad[0])]
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]} {types}"
    return None


def main(argv):
    from terralex.plans.catalog import ORACLES, QUERIES
    from terralex.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    want = argv[1:]
    hit = lambda n: not want or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in want)
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in [n for n in QUERIES if hit(n)]:
        start = time.time()
        try:
            if name in ORACLES:
                df = QUERIES[name](spark, sf_dir)
                problem = compare(df, con, ORACLES[name])
                note = f"ok {type_notes(df, con, ORACLES[name]) or ''}"
            else:
                note = f"rows-only {len(QUERIES[name](spark, sf_dir).collect())}"
                problem = None
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        failed += problem is not None
        print(f"{took:6.1f}s {name}: {problem or note}", flush=True)
    print(f"failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
