"""Compare registered queries with their SQL oracles: python tests/oracle_check.py [sf] [name prefix ...]"""
from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(row) for row in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def ordered(columns: list[str], rows: list[tuple]) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_norm(row[i]) for i in at) for row in rows), key=repr)


def compare(spark_side: tuple[list[str], list[tuple]], duck_side: tuple[list[str], list[tuple]]) -> str | None:
    if sorted(spark_side[0]) != sorted(duck_side[0]):
        return f"columns {sorted(spark_side[0])} vs {sorted(duck_side[0])}"
    if len(spark_side[1]) != len(duck_side[1]):
        return f"rows {len(spark_side[1])} vs {len(duck_side[1])}"
    pairs = list(zip(ordered(*spark_side), ordered(*duck_side)))
    bad = [(x, y) for x, y in pairs if x != y]
    if bad:
        return f"{len(bad)} rows differ, first: {bad[0][0]} vs {bad[0][1]}"
    for x, y in pairs:
        for a, b in zip(x, y):
            if a is not None and b is not None and type(a) is not type(b):
                return f"types {type(a)} vs {type(b)} ({a}, {b})"
    return None


def main() -> None:
    from patronage.session import local_session
    from registry import collect

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(folder), collect.oracles(), []
    for name, fn in collect.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = spark_rows(fn(spark, folder))
            t1 = time.time()
            if name in oracles:
                problem = compare(got, duck_rows(con, oracles[name]))
            else:
                problem = None
            note = "ok" if name in oracles else "rows only"
        except Exception as exc:  # noqa: BLE001
            t1, problem, got = time.time(), f"{type(exc).__name__}: {str(exc)[:900]}", ([], [])
        if problem:
            failed.append(name)
        print(f"{name:42s} {t1 - t0:6.2f}s {len(got[1]):7d} rows  {'FAIL ' + problem if problem else note}", flush=True)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
