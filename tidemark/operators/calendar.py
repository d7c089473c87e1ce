"""Trading calendar work. A calendar has one row per day, so it stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Clock
from ..functions.times import at_clock, day_end


def open_days(calendar: DataFrame, start: str, end: str, strict: bool = True) -> DataFrame:
    """Open days in ``[start, end]``; asking beyond the calendar is an error."""
    inside = calendar.where(F.col("is_open") & F.col("cal_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if not strict:
        return inside.select("cal_date")
    span = calendar.agg(F.min("cal_date").alias("lo"), F.max("cal_date").alias("hi"))
    covered = (F.col("lo") <= F.lit(start).cast("date")) & (F.col("hi") >= F.lit(end).cast("date"))
    guard = F.when(covered, F.lit(True)).otherwise(F.raise_error(F.lit(f"calendar does not cover {start}..{end}")))
    return inside.join(F.broadcast(span), guard).select("cal_date")


def nth_next_open(calendar: DataFrame, n: int) -> DataFrame:
    """For every calendar day, the ``n``-th open day strictly after it."""
    days = Window.orderBy("cal_date")
    opens = calendar.where("is_open").withColumn("_target", F.lead("cal_date", n - 1).over(days))
    later = days.rowsBetween(1, Window.unboundedFollowing)
    marked = calendar.select("cal_date").join(opens.select("cal_date", "_target"), "cal_date", "left")
    return marked.select("cal_date", F.first("_target", ignorenulls=True).over(later).alias("next_open"))


def on_or_next_open(calendar: DataFrame) -> DataFrame:
    """For every calendar day, itself when open, else the next open day."""
    ahead = Window.orderBy("cal_date").rowsBetween(0, Window.unboundedFollowing)
    opened = F.when(F.col("is_open"), F.col("cal_date"))
    return calendar.select("cal_date", F.first(opened, ignorenulls=True).over(ahead).alias("open_day"))


def latest_published(calendar: DataFrame, rule: Clock, when: Column) -> DataFrame:
    """Newest open day whose publication moment has passed at ``when``."""
    opens = calendar.where("is_open").select("cal_date")
    landing = on_or_next_open(calendar).withColumnRenamed("cal_date", "named")
    named = opens.withColumn("named", F.date_add("cal_date", rule.offset))
    if rule.unit == "opens":
        nxt = nth_next_open(calendar, rule.offset)
        named = opens.join(nxt, "cal_date").withColumn("named", F.col("next_open"))
    published = named.join(F.broadcast(landing), "named").where(at_clock(F.col("open_day"), rule.clock) <= when)
    return published.agg(F.max("cal_date").alias("trade_date"))


def month_windows(spark, start: str, end: str) -> DataFrame:
    """Month tiles of a date range with the quarter end each belongs to."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    firsts = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))
    tiles = spark.range(1).select(F.explode(firsts).alias("first"))
    quarter_end = F.last_day(F.add_months(F.trunc("first", "quarter"), 2))
    return tiles.select(
        F.greatest("first", lo).alias("window_start"),
        F.least(F.last_day("first"), hi).alias("window_end"),
        quarter_end.alias("quarter_end"),
    )


def step_windows(spark, start: str, months: int, steps: int) -> DataFrame:
    """Consecutive steps of whole months, numbered from 1."""
    first = F.lit(start).cast("date")
    numbered = spark.range(1, steps + 1).withColumnRenamed("id", "step")
    begin = F.add_months(first, ((F.col("step") - 1) * months).cast("int"))
    return numbered.select("step", begin.alias("step_start"), F.date_sub(F.add_months(begin, months), 1).alias("step_end"))


def replay_days(days: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """First ``limit`` trading days of a span, numbered from 1."""
    inside = days.where(F.col("cal_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    numbered = inside.withColumn("day_no", F.row_number().over(Window.orderBy("cal_date")).cast("long"))
    return numbered.where(F.col("day_no") <= limit)


def due_days(days: DataFrame, period: str) -> DataFrame:
    """First trading day of every new ``day|week|month|quarter|year``."""
    ordered = Window.orderBy("cal_date")
    unit = F.trunc("cal_date", period) if period != "day" else F.col("cal_date")
    marked = days.select("cal_date", unit.alias("period_start"))
    prior = F.lag("period_start").over(ordered)
    return marked.withColumn("_prior", prior).where(F.col("_prior").isNull() | (F.col("_prior") != F.col("period_start"))).drop("_prior")


def publication_stamp(day: Column, rule: Clock | None, next_open: Column | None = None, is_new: bool = False) -> tuple[Column, Column]:
    """``(available_at, rule)`` of a source date under an official rule."""
    if rule is not None and rule.latest_only and not is_new:
        rule = None
    if rule is None:
        stamp, label = day_end(day), F.lit("conservative_date_eod")
    else:
        target = day
        if rule.unit == "opens":
            missing = F.raise_error(F.lit(f"{rule.label}: calendar ends before the publication day")).cast("date")
            target = F.when(day.isNotNull() & next_open.isNull(), missing).otherwise(next_open)
        stamp, label = at_clock(target, rule.clock, rule.offset if rule.unit == "days" else 0), F.lit(rule.label)
    return stamp, F.when(day.isNull(), F.lit("missing_source_date")).otherwise(label)
