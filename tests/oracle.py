"""Side-by-side run of the registered queries and their SQL."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(norm(r[i])) for i in order) for r in rows)


def compare(spark, con, folder, fn, sql):
    """Return a list of problems; empty when both sides agree exactly."""
    df = fn(spark, folder)
    problems = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("decimal", "date", "timestamp"):
            problems.append(f"spark type {f.name} {f.dataType.simpleString()}")
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return problems + ([] if got else ["no rows"])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    for d in res.description:
        if str(d[1]).upper().startswith(("HUGEINT", "DECIMAL", "DATE", "TIMESTAMP")):
            problems.append(f"sql type {d[0]} {d[1]}")
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return problems + [f"columns {sorted(df.columns)} against {sorted(names)}"]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if not a:
        problems.append("no rows")
    if len(a) != len(b):
        problems.append(f"rows {len(a)} against {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        only_a = [x for x in a if x not in sb][:2]
        only_b = [x for x in b if x not in sa][:2]
        problems.append(f"columns {sorted(names)}; {sum(x not in sb for x in a)} differ; spark {only_a}; sql {only_b}")
    return problems


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from shopledger.session import local_session

    folder = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            problems = compare(spark, con, folder, queries[n], sql.get(n))
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:900]}"]
        took = time.time() - t
        if problems:
            bad += 1
            print(f"BAD {n} {took:.1f}s", flush=True)
            for p in problems:
                print("    ", p[:1300], flush=True)
        elif took > 5:
            print(f"slow {n} {took:.1f}s", flush=True)
    print(f"{len(names)} queries, {bad} bad, {sum(n in sql for n in names)} with sql")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
