"""Sorts, latest versions and top-n lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import keep_last

EVENT_ORDER = ("available_at", "dataset", "ts_code", "business_key", "version_rank")


def sort_events(df: DataFrame, order: Sequence[str] = EVENT_ORDER) -> DataFrame:
    """Events in their canonical total order (a range-partitioned sort)."""
    return df.orderBy(*order)


def latest_version(df: DataFrame, keys: Sequence[str], flag: str = "update_flag", tie: Sequence[str] = ()) -> DataFrame:
    """The highest flag of each key; ties go to the largest ``tie`` columns."""
    return keep_last(df, keys, F.coalesce(F.col(flag).try_cast("double"), F.lit(-1.0)), *tie)


def top_n(df: DataFrame, n: int, *order: Column | str, group: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows, overall or per group.

    The row-number bound is applied inside every map task before the shuffle.
    """
    if not group:
        return df.orderBy(*order).limit(n)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window).cast("long")).where(F.col("place") <= n)
