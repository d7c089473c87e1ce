"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "item"):
        return normal(value.item())
    return value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    rows = [tuple(normal(v) for v in row) for row in frame[names].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when equal, else a short description of the first difference."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    for name in sorted(spark_frame.columns):
        a, b = spark_frame[name].dtype.kind, sql_frame[name].dtype.kind
        if a != b and len(spark_frame) and {a, b} != {"O", "M"} and not spark_frame[name].isna().any():
            return f"type of {name}: {spark_frame[name].dtype} != {sql_frame[name].dtype}"
    for left, right in zip(rows_of(spark_frame), rows_of(sql_frame), strict=True):
        if left != right:
            return f"values {left} != {right}"
    return None


def check(spark, con, folder: str, names: list[str]) -> dict[str, str]:
    from tidemark.plans import load_all
    from tidemark.registry import ORACLES, QUERIES

    load_all()
    failures = {}
    for name in names or sorted(QUERIES):
        started = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - started
            if name in ORACLES:
                want = con.execute(ORACLES[name]).df()
                problem = compare(got, want)
            else:
                problem = None if len(got) else "no rows"
            status = "ok" if problem is None else "DIFF"
        except Exception as error:  # noqa: BLE001
            took, problem, status, got = time.time() - started, str(error)[:1500], "FAIL", []
        if problem:
            failures[name] = problem
        print(f"{status:5} {name:38} rows={len(got):7} {took:6.2f}s {'' if name in ORACLES else '(rows only) '}{problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    from tidemark.plans import load_all
    from tidemark.registry import QUERIES
    from tidemark.session import local_session

    load_all()
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    spark = local_session()
    failed = check(spark, connect(folder), folder, names)
    print(f"{len(names) - len(failed)} of {len(names)} ok")
