"""Signal screen: does a score sort the cross-section of what comes next?

Shifts count trading dates, not a name's own rows. Every shift of a panel is a
RANGE frame over the dense date index inside one name, so all of them share a
single shuffle by name; a name has at most one row per date. Ranks run inside a
date, whose size is measured once and split when it is too large for a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import day_rank, present
from .panel import unique_or_fail

KEYS = ["trade_date", "ts_code"]


def date_index(df: DataFrame, day: str = "trade_date") -> DataFrame:
    """Dense index of distinct dates; one row per date."""
    return df.select(day).distinct().withColumn("di", F.row_number().over(Window.orderBy(day)))


def with_index(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    return df.join(F.broadcast(dates if dates is not None else date_index(df)), "trade_date")


def at_shift(column: str | Column, shift: int) -> Column:
    """A name's value exactly ``shift`` trading dates later (null when absent)."""
    frame = Window.partitionBy("ts_code").orderBy("di").rangeBetween(shift, shift)
    return F.max(column).over(frame)


def panel_columns(daily: DataFrame, dates: DataFrame | None = None, decision: str | None = None) -> DataFrame:
    """Row-level panel features on the date grid; dates past ``decision`` fail."""
    opening = F.when(F.col("open") > 0, F.col("open"))
    if decision:
        late = F.col("trade_date") > F.lit(decision).cast("date")
        daily = daily.where(F.when(late, F.raise_error(F.lit("daily history ends after the decision")).cast("boolean")).otherwise(True))
    return with_index(daily, dates).select(
        *KEYS, "di", (opening * F.col("adj_factor")).alias("adj_open"),
        F.coalesce(opening >= F.col("up_limit"), F.lit(False)).alias("at_limit"), F.col("is_suspended").alias("suspended"),
        F.log(F.when(F.col("circ_mv") > 0, F.col("circ_mv"))).alias("log_mv"),
    )


def next_day(panel: DataFrame) -> DataFrame:
    """What the next open allows: a bar, no halt, an open below the up-limit."""
    shifted = panel.withColumns({
        "entry_open": at_shift("adj_open", 1), "limit_next": F.coalesce(at_shift("at_limit", 1), F.lit(False)),
        "suspended_next": F.coalesce(at_shift("suspended", 1), F.lit(False)),
    })
    return shifted.withColumn("tradable_next", F.col("entry_open").isNotNull() & ~F.col("suspended_next") & ~F.col("limit_next"))


def build_panel(daily: DataFrame, decision: str | None = None) -> DataFrame:
    return next_day(panel_columns(daily, decision=decision))


def check_signal(signal: DataFrame) -> DataFrame:
    """Unique (trade_date, ts_code) keys and finite numeric scores, or fail."""
    finite = signal.withColumn("score", F.col("score").cast("double"))
    finite = finite.where(F.col("score").isNotNull() & ~F.isnan("score"))
    infinite = F.abs("score") == float("inf")
    finite = finite.withColumn("score", F.when(infinite, F.raise_error(F.lit("infinite score")).cast("double")).otherwise(F.col("score")))
    return unique_or_fail(finite.select(*KEYS, "score"), KEYS, "signal")


def long_signal(wide: DataFrame, day: str = "trade_date") -> DataFrame:
    """A wide (date x code) score table as long rows."""
    names = [name for name in wide.columns if name != day]
    return wide.unpivot([day], names, "ts_code", "score").where("score is not null")


def wide_table(df: DataFrame, value: str, codes: Sequence[str]) -> DataFrame:
    """Dates x named codes, for export; repeated keys fail."""
    single = unique_or_fail(df.select(*KEYS, value), KEYS, "wide table")
    return single.groupBy("trade_date").pivot("ts_code", list(codes)).agg(F.first(value))


def screen_grid(daily: DataFrame, signal: DataFrame, horizons: Sequence[int], decision: str | None = None) -> DataFrame:
    """Panel and score on one grid with next-day gates, returns and lagged score.

    A score on a known name without a bar that day stays in the grid. A score
    on a date outside the history fails; unknown names are left out.
    """
    dates = date_index(daily)
    panel = panel_columns(daily, dates, decision)
    dated = signal.join(F.broadcast(dates), "trade_date", "left")
    unknown = F.raise_error(F.lit("signal has dates outside the visible history")).cast("int")
    dated = dated.withColumn("di", F.coalesce("di", unknown)).join(daily.select("ts_code").distinct(), "ts_code", "left_semi")
    grid = panel.join(dated.select("di", "ts_code", "score"), ["di", "ts_code"], "full_outer").drop("trade_date").join(F.broadcast(dates), "di")
    grid = next_day(grid)
    opens = {f"_open_{ahead}": at_shift("adj_open", ahead) for ahead in sorted({1 + h for h in horizons})}
    grid = grid.withColumns({**opens, "score_before": at_shift("score", -1)})
    previous, returns = 0, {}
    for horizon in horizons:
        start = F.col("entry_open") if previous == 0 else F.col(f"_open_{1 + previous}")
        returns[f"ret_{horizon}"] = F.try_divide(F.col(f"_open_{1 + horizon}"), F.col("entry_open")) - 1
        returns[f"step_{horizon}"] = F.try_divide(F.col(f"_open_{1 + horizon}"), start) - 1
        previous = horizon
    return grid.withColumns(returns).drop(*opens)


def forward_returns(daily: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Adjusted open(t+1+h) / open(t+1) - 1 and the step from the last horizon."""
    nothing = daily.select(*KEYS, F.lit(None).cast("double").alias("score"))
    grid = screen_grid(daily, nothing, horizons)
    return grid.select(*KEYS, *[f"{kind}_{h}" for h in horizons for kind in ("ret", "step")])


def size_neutral(df: DataFrame, score: str = "score", size: str = "log_mv", name: str = "neutral") -> DataFrame:
    """Residual of the score's rank on log size per date (one-factor fit), in windows over the date's names."""
    both = F.col(score).isNotNull() & F.col(size).isNotNull() & ~F.isnan(score)
    ranked = df.withColumn("_rank", day_rank(["di"], score, both))
    day = Window.partitionBy("di")
    x, s = F.when(F.col("_rank").isNotNull(), F.col(size)), F.col("_rank")
    beta = F.coalesce(F.try_divide(F.covar_pop(s, x).over(day), F.var_pop(x).over(day)), F.lit(0.0))
    residual = (s - F.avg(s).over(day)) - (F.col(size) - F.avg(x).over(day)) * beta
    return ranked.withColumn(name, F.when(s.isNotNull(), residual)).drop("_rank")


def rank_ic(pairs: DataFrame, group: Sequence[str], min_names: int, a: str = "a", b: str = "b") -> DataFrame:
    """Spearman correlation of ``a`` and ``b`` per group over complete pairs.

    Groups with fewer than ``min_names`` pairs, or without spread, are null.
    """
    whole = pairs.where(present(a) & present(b))
    ranked = whole.withColumns({"_ra": day_rank(group, a), "_rb": day_rank(group, b)})
    return ranked.groupBy(*group).agg(F.when(F.count(F.lit(1)) >= min_names, _rank_correlation(F.lit(True), "_ra", "_rb")).alias("ic"), F.count(F.lit(1)).alias("pairs"))


def _rank_correlation(usable: Column, a: str, b: str) -> Column:
    """Correlation of two rank columns. Ranks are half-integers: plain sums are exact, so equal orders cancel to exactly zero."""
    n = F.count_if(usable).cast("double")
    cross = lambda x, y: n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)
    return F.try_divide(cross(a, b), F.sqrt(cross(a, a) * cross(b, b)))


def metric_columns(horizons: Sequence[int]) -> list[tuple[str, int, str, str]]:
    """Every correlation of the report: metric, horizon and its two columns."""
    rows = [("autocorr", 0, "score", "score_before")]
    for h in horizons:
        rows += [("ic", h, "score", f"ret_{h}"), ("ic_marginal", h, "score", f"step_{h}"), ("ic_size_neutral", h, "neutral", f"ret_{h}")]
    return rows


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties share their mean."""
    _, place, copies = np.unique(values, return_inverse=True, return_counts=True)
    return (np.cumsum(copies) - (copies - 1) / 2)[place]


def rank_correlation(a: np.ndarray, b: np.ndarray) -> float | None:
    """Spearman correlation of two columns without gaps; null without spread."""
    n, x, y = float(len(a)), average_ranks(a), average_ranks(b)
    cross = lambda u, v: n * float(u @ v) - float(u.sum()) * float(v.sum())
    spread = cross(x, x) * cross(y, y)
    return cross(x, y) / math.sqrt(spread) if spread > 0 else None


def metric_ics(grid: DataFrame, horizons: Sequence[int], min_names: int) -> DataFrame:
    """Rank correlations of all metrics: one row per (metric, horizon, date) that has pairs.

    Each metric ranks its own complete pairs. A task holds the score and return
    columns of one date's names as arrays and ranks one metric after the other:
    a window for each of the 26 ranks would sort and hold the whole rows anew.
    """
    metrics = metric_columns(horizons)
    needed = sorted({c for _, _, a, b in metrics for c in (a, b)})
    numbers = [F.col(c).cast("double").alias(c) for c in needed]

    def run(names: pa.Table) -> pa.Table:
        values = {c: names.column(c).to_numpy() for c in needed}
        rows = []
        for metric, horizon, a, b in metrics:
            whole = ~(np.isnan(values[a]) | np.isnan(values[b]))
            pairs = int(whole.sum())
            if pairs:
                rows.append((metric, horizon, rank_correlation(values[a][whole], values[b][whole]) if pairs >= min_names else None, pairs))
        columns = list(zip(*rows)) or [()] * 4
        first = pa.array(np.zeros(len(rows), np.int64))
        return pa.table({
            "metric": pa.array(columns[0], pa.string()), "horizon": pa.array(columns[1], pa.int32()), "di": names.column("di").take(first),
            "trade_date": names.column("trade_date").take(first), "ic": pa.array(columns[2], pa.float64()), "pairs": pa.array(columns[3], pa.int64())})

    kinds = {c: grid.schema[c].dataType.simpleString() for c in ("di", "trade_date")}
    days = grid.select("di", "trade_date", *numbers).groupBy("di")
    return days.applyInArrow(run, f"metric string, horizon int, di {kinds['di']}, trade_date {kinds['trade_date']}, ic double, pairs long")


def top_selection(df: DataFrame, fraction: float, name: str = "is_top") -> DataFrame:
    """Mark the best ``ceil(n x fraction)`` tradable names per date, ties by code."""
    usable = F.coalesce(F.col("tradable_next") & F.col("score").isNotNull(), F.lit(False))
    day = Window.partitionBy("di")
    place = F.row_number().over(day.orderBy(usable.desc(), F.col("score").desc(), "ts_code"))
    wanted = F.ceil(F.count_if(usable).over(day) * F.lit(fraction))
    return df.withColumn(name, usable & (place <= wanted))


def summarise(series: DataFrame, group: Sequence[str], value: str, horizon: Column) -> DataFrame:
    """n, mean, std, ratio, overlap-adjusted t, positive day and month shares."""
    clean = series.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_month", F.trunc("trade_date", "month"))
    months = clean.groupBy(*group, "_month").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_sum"), F.sum(F.col(value) * F.col(value)).alias("_sq"),
        F.count_if(F.col(value) > 0).alias("_pos"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.first(horizon).alias("_h"),
    )
    n, total = F.sum("_n"), F.sum("_sum")
    mean = total / n
    # Pooled variance from month means and variances keeps the two-level sum stable.
    within = F.sum(F.col("_n") * F.col("_var"))
    between = F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")) - n * mean * mean
    std = F.sqrt(F.try_divide(F.greatest(within + between, F.lit(0.0)), n - 1))
    return months.groupBy(*group).agg(
        n.alias("n_days"), mean.alias("mean"), F.when(n > 1, std).alias("std"),
        F.when(n > 1, F.try_divide(mean, std)).alias("ratio"), F.when(n > 1, F.try_divide(mean, std) * F.sqrt(n / F.first("_h"))).alias("t_stat"),
        (F.sum("_pos") / n).alias("positive_share"), F.avg(F.when(F.col("_mean") > 0, 1.0).otherwise(0.0)).alias("positive_month_share"),
        F.count(F.lit(1)).alias("n_months"),
    )


def top_excess(grid: DataFrame, horizons: Sequence[int], min_names: int) -> DataFrame:
    """Per date and horizon, mean return of the top minus that of all scored names."""
    scored = F.col("score").isNotNull()
    aggs = [F.count_if(scored & F.col("tradable_next")).alias("_usable"), F.count_if("is_top").alias("top_count")]
    for h in horizons:
        aggs.append((F.avg(F.when(F.col("is_top"), F.col(f"ret_{h}"))) - F.avg(F.when(scored, F.col(f"ret_{h}")))).alias(f"_x_{h}"))
    days = grid.groupBy("trade_date", "di").agg(*aggs)
    good = (F.col("_usable") >= min_names) & (F.col("top_count") > 0)
    rows = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.when(good, F.col(f"_x_{h}")).alias("excess")) for h in horizons])).alias("m")
    return days.select("trade_date", "di", "top_count", (F.col("_usable") >= min_names).alias("usable"), rows).select("trade_date", "di", "top_count", "usable", "m.horizon", "m.excess")


def top_turnover(grid: DataFrame, first_di: int | None = None) -> DataFrame:
    """Share of each date's top names that were not top the date before."""
    fresh = grid.withColumn("_was", F.coalesce(at_shift("is_top", -1), F.lit(False))).where("is_top")
    days = fresh.groupBy("di").agg(F.avg(F.when(F.col("_was"), 0.0).otherwise(1.0)).alias("new_share"), F.count(F.lit(1)).alias("top_count"))
    return days.where(F.col("di") > first_di) if first_di is not None else days


def coverage(grid: DataFrame) -> DataFrame:
    """Scored names per day, their universe share, and what the next open excludes."""
    scored, bar, entry = F.col("score").isNotNull(), F.col("adj_open").isNotNull(), F.col("entry_open").isNotNull()
    days = grid.groupBy("di").agg(
        F.count_if(scored).alias("scored"), F.count_if(scored & bar).alias("scored_bars"), F.count_if(bar).alias("bars"),
        F.count_if(scored & entry).alias("entries"), F.count_if(scored & entry & F.col("limit_next")).alias("limited"),
        F.count_if(scored & (~entry | F.col("suspended_next"))).alias("unavailable"),
    )
    some = F.col("scored") > 0
    return days.agg(
        F.count_if(some).alias("days_scored"), F.avg(F.when(some, F.col("scored"))).alias("names_per_day"),
        F.avg(F.when(some, F.try_divide("scored_bars", "bars"))).alias("universe_share"),
        F.try_divide(F.sum("limited"), F.sum("entries")).alias("limit_excluded_share"),
        F.try_divide(F.sum("unavailable"), F.sum("scored")).alias("unavailable_share"),
    )


def prepare(
    daily: DataFrame, signal: DataFrame | Callable[[DataFrame], DataFrame], horizons: Sequence[int], *, start: str | None = None, end: str | None = None,
    top_fraction: float = 0.1, decision: str | None = None,
) -> DataFrame:
    """The full grid of a screen."""
    scores = check_signal(signal(daily) if callable(signal) else signal)
    grid = screen_grid(daily, scores, horizons, decision)
    if start:
        grid = grid.where(F.col("trade_date") >= start)
    if end:
        grid = grid.where(F.col("trade_date") <= end)
    # One exchange by date for the ranks, the fit and the selection.
    return top_selection(size_neutral(grid.repartition("di")), top_fraction)


def run_screen(
    daily: DataFrame, signal: DataFrame | Callable[[DataFrame], DataFrame], horizons: Sequence[int] = (1, 5, 10, 20), *, min_names: int = 30, **window,
) -> DataFrame:
    """One row per horizon: IC, its decay and size-neutral form, top excess, turnover."""
    grid = materialise(prepare(daily, signal, horizons, **window))
    ic = metric_ics(grid, horizons, min_names)
    ics = summarise(ic, ["metric", "horizon"], "ic", F.greatest("horizon", F.lit(1)))
    # One row per (metric, horizon): turned into columns by an aggregate, not joins.
    pick = lambda metric, column, name: F.max(F.when(F.col("metric") == metric, F.col(column))).alias(name)
    main = ics.where(F.col("metric") != "autocorr").groupBy("horizon").agg(
        pick("ic", "n_days", "n_days"), pick("ic", "mean", "ic_mean"), pick("ic", "std", "ic_std"), pick("ic", "ratio", "icir"), pick("ic", "t_stat", "t_stat"),
        pick("ic", "positive_share", "positive_day_share"), pick("ic", "positive_month_share", "positive_month_share"), pick("ic", "n_months", "n_months"),
        pick("ic_marginal", "mean", "ic_marginal"), pick("ic_size_neutral", "mean", "ic_size_neutral"), pick("ic_size_neutral", "ratio", "icir_size_neutral"))
    excess = top_excess(grid, horizons, min_names)
    tops = summarise(excess.where("excess is not null"), ["horizon"], "excess", F.col("horizon")).select(
        "horizon", F.col("mean").alias("top_excess_mean"), F.col("positive_share").alias("top_excess_hit"), F.col("t_stat").alias("top_excess_t_stat"))
    names = excess.groupBy("horizon").agg(F.avg(F.when(F.col("usable"), F.col("top_count"))).alias("top_names_mean"))
    return main.join(F.broadcast(tops), "horizon", "left").join(F.broadcast(names), "horizon", "left")
