"""Statistical readings over many return series.

A series has one value per trading day, so its prefix sums fit in one row; the
number of series and of bootstrap draws is what grows, and both are rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import digest_numbers
from ..functions.values import DRAW_PRIME, start_number
from .stats import drawdown_path
from .style import TRADING_DAYS, factor_ols

# Minimum days of a regression, draws, block length, power constant.
MIN_DAYS, DRAWS, BLOCK_DAYS, DETECT_Z = 8, 2000, 20, 2.12
# Steps of the numbers that block starts come from.
DRAW_STEP, BLOCK_STEP, MIX = 1_103_515_245, 362_437, 48_271
# Draws of one series that are computed at a time.
LOT_DRAWS = 250


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """1 - Phi(z); there is no built-in error function."""
    return pd.Series([None if value is None or np.isnan(value) else 0.5 * math.erfc(value / math.sqrt(2.0)) for value in z])


def residual_reading(df: DataFrame, group: Sequence[str], y: str, legs: Sequence[str], alpha: float, min_days: int = MIN_DAYS) -> DataFrame:
    """Residual information ratio of each series against its factor legs.

    ``problem`` says why a series could not be read (too short, collinear or
    exactly explained). Days with a missing leg are dropped and counted.
    """
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_all"))
    fits = factor_ols(df, group, y, legs).join(total, list(group), "right")
    n = F.coalesce("n", F.lit(0).cast("long"))
    sigma = F.sqrt(F.try_divide(F.col("rss"), n - (len(legs) + 1)))
    years = n / F.lit(float(TRADING_DAYS))
    scale = F.lit(math.sqrt(TRADING_DAYS))
    problem = F.when(n < min_days, "too_few_days").when(F.col("collinear"), "collinear").when(~(sigma > 1e-12), "exact_fit")
    read = lambda column: F.when(F.col("problem").isNull(), column)
    return fits.withColumns({"problem": problem, "_sigma": sigma}).select(
        *group, n.alias("days"), years.alias("years"), (F.col("_all") - n).alias("dropped_days"), "problem",
        read(F.col("intercept") * TRADING_DAYS).alias("residual_excess"), read(F.col("_sigma") * scale).alias("residual_tracking_error"),
        read(F.try_divide(F.col("intercept") * scale, F.col("_sigma"))).alias("residual_information_ratio"), *[f"beta_{name}" for name in legs],
        F.try_divide(F.lit(NormalDist().inv_cdf(1.0 - alpha)), F.sqrt(years)).alias("threshold"))


def pooled(readings: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Years-weighted pool of readings with its z-score and one-sided p-value."""
    ratio = F.col("residual_information_ratio")
    sums = readings.groupBy(*group).agg(
        F.count(ratio).alias("measured"), F.count_if(ratio.isNull()).alias("unmeasured"),
        F.sum(F.when(ratio.isNotNull(), F.col("years"))).alias("years"), F.sum(ratio * F.col("years")).alias("_weighted"))
    out = sums.withColumn("pooled_ratio", F.try_divide("_weighted", "years")).withColumn("z", F.col("pooled_ratio") * F.sqrt("years"))
    return out.withColumn("p_value", upper_tail("z")).drop("_weighted")


# -- moving-block bootstrap -------------------------------------------------------


def prefix_sums(series: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per series: its day count and the array of running sums from 0."""
    order = Window.partitionBy(*group).orderBy("trade_date")
    marked = series.where("value is not null").select(*group, F.row_number().over(order).alias("_i"), F.sum("value").over(order).alias("_s"))
    rows = marked.groupBy(*group).agg(F.count(F.lit(1)).alias("days"), F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_p"))
    sums = F.concat(F.array(F.lit(0.0)), F.transform("_p", lambda item: item["_s"]))
    return rows.select(*group, "days", sums.alias("prefix"))


def digest_starts(seed: str, draws: np.ndarray, blocks: int, places: int) -> np.ndarray:
    """Where the blocks of each draw begin, among ``places``: each by the MD5 of (seed, draw, block), so none follows from another."""
    numbers = digest_numbers([f"{seed}|{draw}|".encode() for draw in draws], pa.array([str(k) for k in range(blocks)]))
    return numbers.T % places


def stepped_starts(seed: str, draws: np.ndarray, blocks: int, places: int) -> np.ndarray:
    """The same by whole-number steps from one MD5 of the seed."""
    z = (start_number(seed) + draws[:, None] * DRAW_STEP + np.arange(blocks, dtype=np.int64) * BLOCK_STEP) % DRAW_PRIME
    y = (z * z + MIX) % DRAW_PRIME
    return (y * y + z) % DRAW_PRIME * places // DRAW_PRIME


def bootstrap_draws(
    points: DataFrame, group: Sequence[str], seed: Column, draws: int = DRAWS, block: int = BLOCK_DAYS,
    starts: Callable[[str, np.ndarray, int, int], np.ndarray] = digest_starts,
) -> DataFrame:
    """One row per (series, days, draw): the mean of one resample of the first ``days`` days.

    ``points`` has the group, ``prefix`` and an array of ``days``. A resample is
    made of whole blocks, the last one cut to length. A series' running sums are
    held once for all its draws and days; draws are computed in lots.
    """
    short = F.raise_error(F.lit("series shorter than one bootstrap block")).cast("boolean")
    fits = F.when(F.array_min("days") < block, short).otherwise(True)
    rows = points.where(fits).select(*group, "days", "prefix", F.concat_ws("|", seed.cast("string")).alias("seed"))
    names = list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                days, prefix, name = (row.column(len(names) + k)[0].as_py() for k in range(3))
                sums = np.array(prefix)
                for n in days:
                    blocks = -(-n // block)
                    lengths = np.minimum(block, n - np.arange(blocks) * block)
                    for lot in range(0, draws, LOT_DRAWS):
                        numbers = np.arange(lot, min(lot + LOT_DRAWS, draws), dtype=np.int64)
                        at = starts(name, numbers, blocks, n - block + 1)
                        means = (sums[at + lengths] - sums[at]).sum(axis=1) / n
                        repeat = pa.array(np.zeros(len(numbers), np.int64))
                        yield pa.RecordBatch.from_arrays(
                            [*(row.column(k).take(repeat) for k in range(len(names))), pa.array(np.full(len(numbers), n)), pa.array(numbers.astype(np.int32)), pa.array(means)],
                            [*names, "days", "draw", "estimate"])

    kinds = ", ".join(f"`{name}` {points.schema[name].dataType.simpleString()}" for name in names)
    return rows.mapInArrow(run, f"{kinds}, days long, draw int, estimate double")


def block_bootstrap(series: DataFrame, group: Sequence[str], seed: Column, confidence: float, draws: int = DRAWS, block: int = BLOCK_DAYS) -> DataFrame:
    """One-sided lower bound of each series' annualised mean."""
    rows = bootstrap_draws(prefix_sums(series, group).withColumn("days", F.array(F.col("days").cast("long"))), group, seed, draws, block)
    return rows.groupBy(*group).agg(
        (F.percentile("estimate", F.lit(1.0 - confidence)) * TRADING_DAYS).alias("lower_bound"), F.first("days").alias("days"))


def seed_mean(readings: DataFrame, group: Sequence[str], values: Sequence[str], members: str = "member") -> DataFrame:
    """Mean over a book and its replicates; null where any member lacks the value."""
    size = F.count(F.lit(1))
    return readings.groupBy(*group).agg(
        F.count(F.col(members)).alias("members"), *[F.when(F.count(name) == size, F.avg(name)).alias(name) for name in values])


def aligned_mean(series: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Day-by-day mean of member series; a day some member lacks fails."""
    days = series.groupBy(*group, "trade_date").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("_n"))
    sizes = series.groupBy(*group).agg(F.count_distinct(member).alias("_members"))
    odd = F.raise_error(F.lit("a member measured other days than the book")).cast("double")
    joined = days.join(sizes, list(group)) if group else days.join(F.broadcast(sizes))
    return joined.withColumn("value", F.when(F.col("_n") == F.col("_members"), F.col("value")).otherwise(odd)).drop("_n", "_members")


# -- judgements -----------------------------------------------------------------


def mandate(fits: DataFrame, cap: float | None, beta_min: float | None = None, beta_max: float | None = None, beta: str = "beta_market") -> DataFrame:
    """Tracking-error cap and market-beta band over fitted loadings.

    A reading that could not be fitted passes no mandate; no cap, no judgement.
    """
    if cap is None:
        return fits.withColumn("reasons", F.array().cast("array<string>"))
    rules = [("tracking_error_above_cap", F.col("tracking_error") <= cap)]
    if beta_min is not None and beta_max is not None:
        rules.append(("beta_outside_band", F.col(beta).between(beta_min, beta_max)))
    return judge(fits, rules)


def judge(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """Reasons of the named conditions a row fails, in the rules' order."""
    failed = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(reason)) for reason, holds in rules]
    return df.withColumn(name, F.array_compact(F.array(*failed)))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def nomination_rules(max_drawdown: float) -> list[tuple[str, Column]]:
    drawdown = F.col("max_drawdown")
    return [
        ("non_finite_total_return", finite(F.col("total_return"))),
        ("non_finite_max_drawdown", finite(drawdown)),
        ("non_finite_sharpe", F.col("sharpe").isNull() | finite(F.col("sharpe"))),
        ("max_drawdown_above_limit", ~(finite(drawdown) & (F.abs(drawdown) > max_drawdown))),
    ]


def detectable_excess(tracking_error: Column, days: Column | int) -> Column:
    """Smallest annualised excess a test of ``days`` detects at 80 % power."""
    days = F.lit(days) if isinstance(days, int) else days
    return DETECT_Z * tracking_error / F.sqrt(days / F.lit(float(TRADING_DAYS)))


def stressed_excess(plain: Column, days: Column, turnover: Column, multiplier: float, slippage_bps: float) -> Column:
    """Plain excess after ``multiplier`` times the slippage on the span's turnover."""
    return plain - (multiplier - 1.0) * slippage_bps * turnover * 1e-4 / (days / F.lit(float(TRADING_DAYS)))


# -- step records ---------------------------------------------------------------


def step_entries(series: DataFrame, steps: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per series and step: days, mean and compounded return.

    Steps are a short table; each day meets the one step that holds it.
    """
    held = (F.col("trade_date") >= F.col("step_start")) & (F.col("trade_date") <= F.col("step_end"))
    return series.join(F.broadcast(steps), held).groupBy(*group, "step").agg(
        F.count(F.lit(1)).alias("days"), (F.avg("value") * TRADING_DAYS).alias("plain_excess"), (F.exp(F.sum(F.log1p("value"))) - 1).alias("compounded"))


def contiguous(entries: DataFrame, group: Sequence[str]) -> DataFrame:
    """Step counts per group; a gap in 1..k fails."""
    counts = entries.groupBy(*group).agg(F.count_distinct("step").alias("steps"), F.max("step").alias("_last"), F.count(F.lit(1)).alias("_rows"))
    broken = F.raise_error(F.lit("steps are not the contiguous 1..k")).cast("bigint")
    return counts.withColumn("steps", F.when((F.col("steps") == F.col("_last")) & (F.col("_rows") == F.col("steps")), F.col("steps")).otherwise(broken)).drop("_last", "_rows")


def candidate_changes(entries: DataFrame, group: Sequence[str], fingerprint: str = "fingerprint") -> DataFrame:
    """How often the fingerprint changed between consecutive steps."""
    order = Window.partitionBy(*group).orderBy("step")
    moved = entries.withColumn("_moved", (F.col(fingerprint) != F.lag(fingerprint).over(order)).cast("long"))
    return moved.groupBy(*group).agg(F.coalesce(F.sum("_moved"), F.lit(0)).alias("changes"))


def first_transition(
    paths: DataFrame, group: Sequence[str], *, max_drawdown: float, active_max_drawdown: float, checkpoint_days: int,
    kill_confidence: float, confirm_confidence: float, draws: int = DRAWS, block: int = BLOCK_DAYS,
) -> DataFrame:
    """First terminal event of each book: drawdown kill, else a checkpoint verdict.

    ``paths`` has (group, trade_date, account, active) daily returns. All
    checkpoints of a book read one prefix-sum row, so no prefix is copied.
    """
    order = Window.partitionBy(*group).orderBy("trade_date")
    numbered = paths.withColumn("days", F.row_number().over(order).cast("long"))
    account = drawdown_path(numbered, group, "account").withColumnRenamed("drawdown", "account_drawdown").drop("equity", "cumulative")
    both = drawdown_path(account, group, "active").withColumnRenamed("drawdown", "active_drawdown").drop("equity", "cumulative")
    prefixes = prefix_sums(paths.withColumn("value", F.col("active")), group).withColumnRenamed("days", "_total")
    marks = F.sequence(F.lit(checkpoint_days).cast("long"), F.col("_total"), F.lit(checkpoint_days).cast("long"))
    points = prefixes.where(F.col("_total") >= F.lit(max(checkpoint_days, block))).withColumn("days", F.filter(marks, lambda n: n >= block))
    drawn = bootstrap_draws(points, group, F.concat_ws("|", *group), draws, block, stepped_starts)
    bounds = drawn.groupBy(*group, "days").agg(
        (F.percentile("estimate", F.lit(1.0 - confirm_confidence)) * TRADING_DAYS).alias("confirm_lower_bound"),
        (F.percentile("estimate", F.lit(kill_confidence)) * TRADING_DAYS).alias("kill_upper_bound"))
    judged = both.join(bounds, [*group, "days"], "left")
    reason = (
        F.when(F.col("account_drawdown") > max_drawdown, "account_drawdown_exceeded")
        .when(F.col("active_drawdown") > active_max_drawdown, "active_drawdown_exceeded")
        .when(F.col("kill_upper_bound") < 0, "kill_upper_bound_below_zero").when(F.col("confirm_lower_bound") > 0, "confirm_lower_bound_above_zero"))
    events = judged.withColumn("reason", reason).where("reason is not null")
    row = F.struct("trade_date", "reason", "account_drawdown", "active_drawdown", "confirm_lower_bound", "kill_upper_bound")
    first = events.groupBy(*group).agg(F.min("days").alias("days"), F.min_by(row, "days").alias("_e"))
    status = F.when(F.col("_e.reason") == "confirm_lower_bound_above_zero", "confirmed").otherwise("killed")
    return first.select(*group, "days", status.alias("status"), "_e.*")
