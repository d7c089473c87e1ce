"""Who belonged where, on a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .ordered import keep_last

# Fixed value: the industry scheme switched on this day.
SCHEME_SWITCH = "2021-12-13"


def membership_asof(intervals: DataFrame, day: Column, code: str = "ts_code") -> DataFrame:
    """Intervals with ``in <= day < out`` (blank out = open); latest entry wins."""
    out_date = F.col("out_date")
    open_end = out_date.isNull() | out_date.isin("", "None")
    inside = intervals.where((F.coalesce("in_date", F.lit("")) <= day) & (open_end | (out_date > day)))
    rest = [name for name in intervals.columns if name not in (code, "in_date")]
    return keep_last(inside, [code], "in_date", *rest).drop("in_date", "out_date")


def industry_asof(old: DataFrame, new: DataFrame, names: DataFrame, day: str) -> DataFrame:
    """The scheme in force on ``day`` (YYYY-MM-DD) with its group names."""
    compact = F.lit(day.replace("-", ""))
    if day < SCHEME_SWITCH:
        return membership_asof(old, compact).join(F.broadcast(names), "l1_code", "left").select("ts_code", "l1_code", "l1_name")
    return membership_asof(new, compact).select("ts_code", "l1_code", "l1_name")


def names_asof(changes: DataFrame, day: Column) -> DataFrame:
    """Last name started by the day and announced by then (or undated)."""
    known = F.col("ann_date").isNull() | (F.trim("ann_date") <= day)
    usable = changes.where(known & (F.col("start_date") <= day))
    return usable.groupBy("ts_code").agg(F.max_by("name", F.struct("start_date", "name")).alias("name"))


def sections_before(trips: DataFrame, weights: DataFrame, day: str = "entry_day") -> DataFrame:
    """Attach the latest constituent section dated strictly before each trip day."""
    sections = weights.select(F.col("trade_date").alias("section")).distinct()
    days = trips.select(day).distinct()
    found = asof_join(days, sections, [], day, "section", ["section"], strict=True, bounded=True)
    refused = F.raise_error(F.lit("no constituent section before a trip day")).cast("date")
    found = found.withColumn("section", F.coalesce("section", refused))
    return trips.join(found, day, "left")


def members_before(trips: DataFrame, weights: DataFrame, day: str = "entry_day") -> DataFrame:
    """``is_member``: the trip's code is in the section in force before its day."""
    dated = sections_before(trips, weights, day)
    marks = weights.select(F.col("trade_date").alias("section"), F.col("con_code").alias("ts_code")).distinct().withColumn("_in", F.lit(True))
    return dated.join(marks, ["section", "ts_code"], "left").withColumn("is_member", F.col("_in").isNotNull()).drop("_in")
