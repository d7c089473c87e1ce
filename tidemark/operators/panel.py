"""Daily panels and price lookups keyed by (trade_date, code)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import usable_price

KEYS = ["trade_date", "ts_code"]


def unique_or_fail(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The same rows, failing the job when a key repeats.

    The copies are counted by a combinable aggregate, one row per key.
    """
    rest = [name for name in df.columns if name not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(name).alias(name) for name in rest])
    refused = F.raise_error(F.lit(f"{what} has duplicate keys {list(keys)}")).cast("boolean")
    return counted.where(F.when(F.col("_n") > 1, refused).otherwise(F.lit(True))).select(*df.columns)


def daily_panel(
    daily: DataFrame, basic: DataFrame, limits: DataFrame, adjust: DataFrame, suspend: DataFrame,
    visible: dict[str, Column] | None = None, check: bool = True,
) -> DataFrame:
    """daily left-joined with basics, limits, factors and a halt flag.

    ``visible`` holds one predicate per side, so a table that publishes later
    only joins on the dates already public. All joins share one key, so one
    shuffle per side serves the chain. A side's repeats of ``close`` and
    ``pre_close`` are dropped.
    """
    seen = visible or {}
    sides = {"daily": daily, "daily_basic": basic.drop("close"), "stk_limit": limits.drop("pre_close"), "adj_factor": adjust}
    sides = {name: df.where(seen[name]) if name in seen else df for name, df in sides.items()}
    if check:
        sides = {name: unique_or_fail(df, KEYS, name) for name, df in sides.items()}
    out = sides["daily"]
    for name in ("daily_basic", "stk_limit"):
        out = out.join(sides[name], KEYS, "left")
    out = out.join(sides["adj_factor"].select(*KEYS, "adj_factor"), KEYS, "left")
    halts = suspend.where(seen["suspend_d"]) if "suspend_d" in seen else suspend
    return halt_flag(out, halts)


def halt_flag(panel: DataFrame, suspend: DataFrame) -> DataFrame:
    """``is_suspended``: the key has a halt row; resumptions do not count."""
    halted = suspend.where(F.col("suspend_type") == "S").select(*KEYS).distinct().withColumn("_halted", F.lit(True))
    return panel.join(halted, KEYS, "left").withColumn("is_suspended", F.col("_halted").isNotNull()).drop("_halted")


def last_close(daily: DataFrame, close: str = "close", name: str = "last_close") -> DataFrame:
    """The latest usable close before each row, carried over gaps.

    A code has one row per trading day, so its window is bounded by the calendar.
    """
    before = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.withColumn(name, F.last(usable_price(F.col(close)), ignorenulls=True).over(before))


def price_resets(daily: DataFrame) -> DataFrame:
    """Days that open from another price than the close carried into them."""
    marked = last_close(daily).withColumn("pre_close", usable_price(F.col("pre_close")))
    return marked.where(F.col("pre_close") != F.col("last_close")).select("ts_code", "trade_date", "last_close", "pre_close")


def prior_day(daily: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach each name's value on its own previous row."""
    own = Window.partitionBy("ts_code").orderBy("trade_date")
    return daily.withColumns({f"prior_{name}": F.lag(name).over(own) for name in columns})


def price_at(orders: DataFrame, minutes: DataFrame, when: str = "execute_at") -> DataFrame:
    """Close of exactly the order's minute, if that bar was public by then.

    Two bars for one (code, minute) fail the job; nothing is rounded or filled.
    """
    bars = unique_or_fail(minutes.select("ts_code", "minute", "close", "available_at"), ["ts_code", "minute"], "minute bars")
    joined = orders.withColumn("minute", F.concat(F.substring(F.col(when).cast("string"), 1, 16), F.lit(":00")).cast("timestamp_ntz")).join(bars, ["ts_code", "minute"], "left")
    known = F.when(F.col("available_at") <= F.col(when), F.col("close"))
    return joined.withColumn("price", known).drop("close", "available_at", "minute")


def reproduction(first: DataFrame, second: DataFrame, keys: Sequence[str], legs: Sequence[str], through: Column | None = None) -> DataFrame:
    """Per leg, days on which two runs of one series differ or one lacks the day."""
    a, b = (df.where(F.col(keys[0]) <= through) if through is not None else df for df in (first, second))
    left = a.select(*keys, *[F.col(leg).alias(f"_a_{leg}") for leg in legs], F.lit(1).alias("_in_a"))
    right = b.select(*keys, *[F.col(leg).alias(f"_b_{leg}") for leg in legs], F.lit(1).alias("_in_b"))
    both = left.join(right, list(keys), "full_outer")
    missing = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    sums = []
    for leg in legs:
        differs = ~missing & ~F.col(f"_a_{leg}").eqNullSafe(F.col(f"_b_{leg}"))
        sums += [F.count_if(differs).alias(f"{leg}_differs"), F.count_if(missing).alias(f"{leg}_missing")]
    wide = both.agg(*sums)
    rows = F.explode(F.array(*[
        F.struct(F.lit(leg).alias("leg"), F.col(f"{leg}_differs").alias("differing"), F.col(f"{leg}_missing").alias("missing")) for leg in legs
    ]))
    return wide.select(rows.alias("r")).select("r.*")


def apply_screen(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drop stock-level rows outside the allowed set; index-level rows pass."""
    marks = allowed.select("ts_code").distinct().withColumn("_ok", F.lit(True))
    stock = F.col("ts_code").rlike(r"^\d{6}\.(SH|SZ|BJ)$")
    joined = df.join(marks, "ts_code", "left")
    return joined.where(~F.coalesce(stock, F.lit(False)) | F.col("_ok").isNotNull()).drop("_ok")


def span_daily(slots: Sequence[DataFrame], start: Column, end: Column) -> DataFrame:
    """Bars of consecutive slots restricted to one span."""
    out = slots[0]
    for slot in slots[1:]:
        out = out.unionByName(slot)
    return out.where(F.col("trade_date").between(start, end))


def candidate_codes(df: DataFrame, columns: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Codes with any of several announcement dates inside a window."""
    hit = None
    for name in columns:
        one = F.coalesce(F.col(name).between(start, end), F.lit(False))
        hit = one if hit is None else hit | one
    return df.where(hit).select("ts_code").distinct()
