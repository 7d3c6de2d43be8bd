"""Run registered queries next to their SQL on DuckDB and compare whole results.

    python tests/side_by_side.py [sf_dir] [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(got)})"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"DIFFER: columns {sorted(df.columns)} != {sorted(names)}"
    a, b = normal(got, df.columns), normal(want, names)
    if a == b:
        return f"ok ({len(got)})"
    in_a, in_b = set(a), set(b)
    only_a, only_b = sorted(in_a - in_b)[:2], sorted(in_b - in_a)[:2]
    return f"DIFFER: {len(a)} vs {len(b)} rows\n  spark: {only_a}\n  sql:   {only_b}"


def main() -> None:
    import __spark_entry__ as entry
    from linefold.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    for name in entry.queries():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            verdict = f"DIFFER: {type(error).__name__}: {str(error)[:600]}"
        print(f"\n@ {name}: {verdict} [{time.time() - start:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
