"""Compare registered queries with their oracle SQL: `python tests/check.py SF [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return repr(value)


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both results hold the same columns and rows, else what differs."""
    got_names = sorted(df.columns)
    rows = df.select(*got_names).collect()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != got_names:
        return f"columns {got_names} != {sorted(names)}"
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
    got = sorted(tuple(_plain(v) for v in r) for r in rows)
    if got == want:
        return None
    extra = next((g for g in got if g not in set(want)), None)
    missing = next((w for w in want if w not in set(got)), None)
    return f"rows {len(got)} != {len(want)}; only here: {extra}; only there: {missing}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from reviewmill.session import build_session

    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false",
    })
    folder = f"/root/testdata/sf{sys.argv[1]}"
    connection = oracle_connection(folder)
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = difference(run(spark, folder), connection, oracles[name]) or "ok"
            else:
                verdict = f"rows {run(spark, folder).count()} (no oracle)"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:34s} {time.time() - start:6.1f}s  {verdict}", flush=True)
