"""Points inside intervals, as an equi-join.

Every interval takes the scale of its own length (the power of two days that
covers it) and lies in one or two cells of that scale; a point lies in one cell
of each scale in use. Points and intervals meet in cells and an exact filter
follows, so what an interval meets is bounded by a few times its own length,
whatever the table's span, and no side is compared with all of the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _day(column: str) -> Column:
    return F.unix_date(F.col(column).cast("date"))


def _cell(day: Column, scale: Column) -> Column:
    return F.floor(day / F.pow(F.lit(2.0), scale)).cast("long")


def inside(points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each point with every interval of its keys that holds it, both ends included; dates, null ends hold nothing.

    Column names of the two sides must differ but for ``keys``.
    """
    scale = F.ceil(F.log2(_day(hi) - _day(lo) + 1.0)).cast("int")
    scaled = intervals.where(F.col(lo) <= F.col(hi)).withColumn("_scale", scale)
    # At most one number for each power of two of a calendar's days.
    scales = sorted(row[0] for row in scaled.select("_scale").distinct().collect())
    if not scales:
        return points.join(intervals.where("false"), list(keys)) if keys else points.join(intervals.where("false"))
    cells = scaled.withColumn("_cell", F.explode(F.sequence(_cell(_day(lo), F.col("_scale")), _cell(_day(hi), F.col("_scale")))))
    spread = points.withColumn("_scale", F.explode(F.array(*map(F.lit, scales)))).withColumn("_cell", _cell(_day(point), F.col("_scale")))
    met = spread.join(cells, [*keys, "_scale", "_cell"])
    return met.where(F.col(point).between(F.col(lo), F.col(hi))).drop("_scale", "_cell")
