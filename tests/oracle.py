"""Run registered queries against DuckDB: python -m tests.oracle [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

from ragmill.tables import TABLES

DEFAULT_DIR = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def compare(spark, con, fn, sql, sf_dir):
    """(rows, message): an empty message means equal."""
    df = fn(spark, sf_dir)
    got, got_names = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), "" if got else "no rows"
    cur = con.execute(sql)
    types = [(d[0], str(d[1])) for d in cur.description]
    want, want_names = rows([t[0] for t in types], cur.fetchall())
    if got_names != want_names:
        return len(got), f"columns {got_names} != {want_names}"
    if got != want:
        got_set, want_set = set(got), set(want)
        extra = [r for r in got if r not in want_set][:3]
        missing = [r for r in want if r not in got_set][:3]
        return len(got), f"{len(got)} vs {len(want)} rows\n   got  {extra}\n   want {missing}"[:3000]
    spark_types = dict(df.dtypes)
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    odd = [(n, spark_types[n], t) for n, t in types if loose.get(spark_types[n]) != t]
    if odd:
        return len(got), f"types {odd}"
    return len(got), "" if got else "no rows"


def main(argv):
    import __spark_entry__ as contract
    from ragmill.session import local_session

    sf_dir = argv[0] if argv else DEFAULT_DIR
    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = contract.queries(), contract.oracle_sql()
    wanted = argv[1:]
    names = [n for n in queries if not wanted or n in wanted or queries[n].__module__.split(".")[-1] in wanted]
    bad = 0
    for name in names:
        start = time.time()
        try:
            n, message = compare(spark, con, queries[name], oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - report and go on
            n, message = 0, "".join(traceback.format_exception_only(exc))[:1500]
        bad += bool(message)
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if not message else 'BAD '} {kind} {time.time() - start:6.2f}s {n:7d} {name} {message}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
