"""Run registered queries against their oracle SQL: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tabwarden.plans.session import session  # noqa: E402
from tabwarden.workload.planted import TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only ({len(mine)})"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"DIFF columns {sorted(df.columns)} {sorted(names)}"
    duck = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    types = {d[0]: duck.get(str(d[1]), str(d[1])) for d in cur.description}
    if types != dict(df.dtypes):
        return f"DIFF types {sorted(set(types.items()) ^ set(df.dtypes))}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
        return f"DIFF {len(mine)} rows, oracle {len(theirs)}: {str(bad)[:700]}"
    kinds = {type(v).__name__ for r in mine for v in r}
    return f"ok {len(mine)} rows {sorted(kinds)}"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = f"/root/testdata/{args[0] if args else 'sf0.01'}"
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in args[1:] or entry.queries():
        start = time.time()
        try:
            verdict = compare(spark, con, sf, name)
        except Exception as e:
            verdict = f"FAIL {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)
