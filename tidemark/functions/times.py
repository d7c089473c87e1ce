"""Wall-clock expressions.

Every stamp is a zone-free timestamp in market-local time (UTC+8), so no
result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_OFFSET_MINUTES = 8 * 60


def at_clock(day: Column, clock: str, days: int | Column = 0) -> Column:
    """``day`` (a date) plus whole days at ``HH:MM[:SS]``."""
    hours, minutes, seconds = ([int(part) for part in clock.split(":")] + [0])[:3]
    shift = F.lit(days) if isinstance(days, int) else days
    return day.cast("timestamp_ntz") + F.make_dt_interval(shift, F.lit(hours), F.lit(minutes), F.lit(seconds).cast("decimal(18,6)"))


def day_end(day: Column, days: int = 0) -> Column:
    return at_clock(day, "23:59:59", days)


def compact_date(text: Column) -> Column:
    """Date of a trimmed ``YYYYMMDD`` text, null for anything else."""
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed.rlike(r"^\d{8}$"), F.try_to_date(trimmed, "yyyyMMdd"))


def date_text(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def date_key(value: Column) -> Column:
    """``YYYYMMDD`` from text, date or timestamp spellings; '' where none fits."""
    digits = F.substring(F.regexp_replace(F.trim(value.cast("string")), r"\D", ""), 1, 8)
    return F.coalesce(F.when(F.length(digits) == 8, digits), F.lit(""))


def market_time(text: Column) -> Column:
    """Mixed stamp spellings as market-local timestamps, null when unreadable.

    A ``T`` or blank separates date and clock; a stamp with an offset is moved
    to market time, one without is market time already.
    """
    pattern = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s*(Z|[+-]\d{2}:?\d{2})?\s*$"
    day, clock, zone = (F.regexp_extract(text, pattern, group) for group in (1, 2, 3))
    wall = F.when(day != "", F.concat_ws(" ", day, clock)).try_cast("timestamp_ntz")
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    minutes = F.when(digits == "", F.lit(0)).otherwise(
        F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    )
    offset = F.when(zone == "", F.lit(MARKET_OFFSET_MINUTES)).otherwise(F.when(zone.startswith("-"), -minutes).otherwise(minutes))
    return wall + F.make_dt_interval(mins=F.lit(MARKET_OFFSET_MINUTES) - offset)


def source_time(text: Column) -> Column:
    """Vendor clock text (``YYYYMMDD HH:MM:SS`` or dashed) as market time."""
    trimmed = F.trim(text.cast("string"))
    dashed = F.regexp_replace(trimmed, r"^(\d{4})(\d{2})(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3 $4")
    return market_time(dashed)


def stamp_text(stamp: Column) -> Column:
    """The stored text form of a stamp, null for null."""
    return F.concat(F.substring(stamp.cast("timestamp_ntz").cast("string"), 1, 19), F.lit("+08:00"))


def ceil_second(stamp: Column) -> Column:
    floor = F.substring(stamp.cast("string"), 1, 19).cast("timestamp_ntz")
    return F.when(floor == stamp, stamp).otherwise(floor + F.make_dt_interval(secs=F.lit(1).cast("decimal(18,6)")))


def months_after_rolling(day: Column, months: int) -> Column:
    """Same day-of-month ``months`` later; a missing day rolls to the next 1st."""
    clamped = F.add_months(day, months)
    return F.when(F.dayofmonth(clamped) < F.dayofmonth(day), F.date_add(clamped, 1)).otherwise(clamped)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)
