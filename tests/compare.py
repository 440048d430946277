"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python -m tests.compare [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from keystead.plans.testbed import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A value in one spelling for both engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def kind(name: str) -> str:
    """Type family of a Spark or DuckDB type name; results must agree on it."""
    n = name.lower()
    if n in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "int"
    if n in ("double", "float"):
        return "float"
    if n in ("string", "varchar"):
        return "string"
    return n.split("(")[0]


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    return [(n, kind(dict(df.dtypes)[n])) for n in names], sorted(rows, key=_key)


def duck_rows(con, sql):
    con.execute(sql)
    cols = [d[0] for d in con.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = [tuple(plain(r[i]) for i in order) for r in con.fetchall()]
    return [(cols[i], kind(str(con.description[i][1]))) for i in order], sorted(rows, key=_key)


def difference(spark_result, duck_result) -> str | None:
    (a_names, a), (b_names, b) = spark_result, duck_result
    if a_names != b_names:
        return f"columns {sorted(set(a_names) - set(b_names))} vs {sorted(set(b_names) - set(a_names))}"
    if len(a) != len(b):
        only_a = sorted(set(a) - set(b), key=_key)[:3]
        only_b = sorted(set(b) - set(a), key=_key)[:3]
        return f"rows {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        only_a = sorted(set(a) - set(b), key=_key)[:3]
        only_b = sorted(set(b) - set(a), key=_key)[:3]
        return f"{len(bad)} of {len(a)} rows differ: {a_names}\n   spark {only_a}\n   sql   {only_b}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from keystead.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = []
    for name in names:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            spent = time.time() - start
            if name not in sqls:
                print(f"rows  {name:28s} {len(got[1]):7d} {spent:6.2f}s", flush=True)
                continue
            start = time.time()
            want = duck_rows(con, sqls[name])
            diff = difference(got, want)
            mark = "ok   " if diff is None and want[1] else ("EMPTY" if diff is None else "DIFF ")
            print(f"{mark} {name:28s} {len(got[1]):7d} {spent:6.2f}s  sql {time.time() - start:5.2f}s", flush=True)
            if diff or not want[1]:
                failed.append(name)
                if diff:
                    print("   ", diff[:1500], flush=True)
        except Exception as e:  # noqa: BLE001 - a check run goes on with the next query
            failed.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:1200]}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
