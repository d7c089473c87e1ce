"""Registry of named queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


def spell_rounding(sql: str) -> str:
    """Write every ``round(x, n)`` as the floor form :func:`rounded` uses.

    Engines break decimal ties differently; both sides use one formula whose
    ties lie where no decimal value does. ``ROUND`` in capitals is left alone.
    """
    out, at = [], 0
    while True:
        found = sql.find("round(", at)
        if found < 0:
            return "".join(out) + sql[at:]
        if found and (sql[found - 1].isalnum() or sql[found - 1] == "_"):
            out.append(sql[at:found + 6])
            at = found + 6
            continue
        depth, end, comma = 1, found + 6, -1
        while depth:
            char = sql[end]
            depth += (char == "(") - (char == ")")
            if char == "," and depth == 1:
                comma = end
            end += 1
        inner, places = spell_rounding(sql[found + 6:comma]), int(sql[comma + 1:end - 1])
        out.append(sql[at:found] + f"(floor(({inner}) * 1e{places} + 0.5001) / 1e{places})")
        at = end


def rounded(column: Column, places: int = 6) -> Column:
    """Round for comparison; see :func:`spell_rounding`."""
    scale = float(10**places)
    return F.floor(column * scale + 0.5001) / scale


QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, folder)`` under ``name`` with its equivalent SQL."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = spell_rounding(sql)
        return fn

    return register
