"""Places of rows in a total order, for groups of any size.

Rows are range-partitioned by group and order, so a hot group spreads over many
tasks; each task numbers its own run of a group, and one small row per run and
task carries the totals of the runs before it. There is one path for every
size: no measuring job, no cut points on the driver, no group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Low bits of ``monotonically_increasing_id`` count rows; the rest is the task.
ROW_BITS = 33


def same(left: list[Column], right: list[Column]) -> Column:
    """Equality of all columns, nulls equal to nulls."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right, strict=True)))


def ordered_runs(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows stored in range partitions, with ``_task`` and a row number ``_at`` that ascends in the order within the task.

    Rows equal in group and order keep the place their input gives them, so a
    third of all rows may be copies of one.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order, F.col("_tie").asc()]
    placed = tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialise(placed.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    rows = stored.withColumn("_task", F.shiftright("_at", ROW_BITS))
    rows.scratch = stored.scratch  # so that :func:`~tidemark.session.discard` finds the table
    return rows


def numbered(df: DataFrame, group: list[str], order: list[Column], position: str = "position", total: str | None = "n") -> DataFrame:
    """``df`` with each row's place (from 0) in its group's order, and the group's size."""
    rows = ordered_runs(df, group, order)
    runs = rows.groupBy(*group, "_task").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    # At most one row for each task: a bounded window even for a hot group.
    own = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before", before).withColumn("_all", F.sum("_rows").over(own)).alias("runs")
    met = rows.alias("rows").join(runs, same([F.col(f"rows.{g}") for g in group], [F.col(f"runs.{g}") for g in group]) & (F.col("rows._task") == F.col("runs._task")) if group else F.col("rows._task") == F.col("runs._task"))
    columns = [F.col(f"rows.`{c}`") for c in df.columns]
    extra = [F.col("_all").alias(total)] if total else []
    return met.select(*columns, (F.col("_at") - F.col("_low") + F.col("_before")).alias(position), *extra)
